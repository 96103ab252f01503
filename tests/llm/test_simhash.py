"""SimHash near-duplicates against a brute-force version."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortspark.llm import simhash
from cohortspark.llm.components import connected_components

DATA = "/root/testdata/sf0.001"


def brute_fingerprint(text, n=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, max_bits=4):
    ids, prints = [r[0] for r in rows], np.array([r[1] for r in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= max_bits):
            parent[find(int(j))] = find(i)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [(x, least.get(find(i))) for i, x in enumerate(ids)]


def result(docs):
    rows = simhash.near_duplicates(docs).withColumn("hex", simhash.as_hex(F.col("fingerprint_bits"))).collect()
    return rows


def check(docs):
    rows = result(docs)
    want = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, int(r.hex, 16)) for r in rows], key=key) == sorted(want, key=key)
    prints = sorted(want, key=key)
    got = sorted([(r.doc_id, int(r.hex, 16), r.component_id) for r in rows], key=key)
    assert [(g[0], g[2]) for g in got] == brute_components(prints)


def test_documents(spark):
    check(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"))


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (4, "one TWO"), (5, "a b c d e"), (None, "lonely words only here"), (7, "x " * 30000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("tile", [8, 1024])
def test_dense_group_in_tiles(spark, monkeypatch, tile):
    """Hundreds of fingerprints within a few bits of one another share cells, small and large."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    prints = {0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), False)) for _ in range(300)}
    prints |= {int(x) for x in rng.integers(0, 2**63, 200)}
    rows = [(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(sorted(prints))]
    marked = spark.createDataFrame(rows, "doc_id long, fingerprint_bits long")
    got = {r.doc_id: r.component_id for r in simhash.with_components(marked).collect()}
    assert got == dict(brute_components([(i, p % 2**64) for i, p in rows]))


def test_keep_one(spark):
    text = "the quick brown fox jumps over the lazy dog again and again until night falls"
    rows = [(3, text, "a"), (2, text, "b"), (2, text, "b"), (9, "something else entirely is written in this text here", "c"), (None, text, "d"), (None, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_hash string")
    kept = sorted([(r.doc_id, r.row_hash) for r in simhash.keep_one(docs).collect()], key=str)
    assert kept == sorted([(2, "b"), (9, "c"), (None, "e")], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100}


def test_extra_columns(spark):
    """Columns with the operator's own names, and a very long text, change nothing."""
    texts = [None, "", "a b c d e f", "A b c d e f", "w " * 200_000, "a b"]
    rows = [(i, t, "x", 5, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fingerprint_bits long, n string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}
