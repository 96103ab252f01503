"""Quality rules against a plain version of the counts and the ratio."""

import math
import re

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import quality
from cohortspark.llm.queries import op10_quality_llr

DATA = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


TEXTS = [None, "", " \n\t", "one", "a b c a b c", "a a a a a", "é é é # $ <\n\nx\nx\nx y", "a b c d " * 40, "w " * 60, "\x0bq\x0cr\rs", "x\u00a0y \u3000", "line one\nline one\n  \nline two"]


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


@pytest.mark.parametrize("bits", [21, 3])
def test_counts(spark, monkeypatch, bits):
    """Also with so few position bits that the exact sort must decide."""
    monkeypatch.setattr(quality, "_POSITION_BITS", bits)
    texts = [*TEXTS, " ".join(str(i % 997) for i in range(30_000))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words_of_text string")
    got = {r.doc_id: counts(r) for r in quality.with_counts(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert quality.with_counts(docs.limit(0)).collect() == []


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}
    words = {i: re.findall(WORD, t or "") for i, t in texts.items()}
    grams = {i: [*[(w,) for w in ws], *zip(ws, ws[1:])] for i, ws in words.items()}
    distinct = sorted({g for gs in grams.values() for g in gs})
    hashed = spark.createDataFrame([(g[0], g[-1], len(g)) for g in distinct], "a string, b string, n int")
    value = F.when(F.col("n") == 1, F.xxhash64("a")).otherwise(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")))
    hashed = hashed.select("a", "b", "n", F.pmod(value, F.lit(quality.BUCKETS)).alias("at")).collect()
    bucket = {(r.a, r.b)[: r.n]: r["at"] for r in hashed}
    total, trusted = [1] * quality.BUCKETS, [0] * quality.BUCKETS
    for i, gs in grams.items():
        for g in gs:
            total[bucket[g]] += 1
            trusted[bucket[g]] += i in good
    weight, n_all, n_good = [], sum(total), sum(trusted)
    for t, a in zip(trusted, total):
        p = a / n_all if a > 1 else None
        weight.append(p and round(math.log((t + quality.BUCKETS * p) / (n_good + quality.BUCKETS) / p) * 1e6))
    rows = op10_quality_llr(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert counts(r) == brute(texts[r.doc_id])
        gs = grams[r.doc_id]
        score = sum(weight[bucket[g]] for g in gs) / 1e6 / len(gs) if gs else None
        assert r.score == score or abs(r.score - score) < 2e-6
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_larger_grams_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30, "k"), (1, "a b c " * 30, "k"), (None, "d e f " * 30, None)], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for order in (1, 2, 3):
        rows = quality.judge(docs, labels, order=order).collect()
        assert len(rows) == 3 and all(r.base_failed and not r.kept for r in rows)
        assert rows[0].score == rows[0].score
