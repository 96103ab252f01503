"""Near duplicates by similarity of word shingles, against all pairs."""

import random

import corpus_pipeline
from cohortspark.llm import shingles, simhash
from cohortspark.llm.shared import staged
from tests.llm.test_simhash import brute_fingerprint


def brute_similarity(x: str, y: str) -> float:
    a, b = (t.lower().split() for t in (x, y))
    a, b = ({tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_keep_one_by_similarity(spark):
    draw = random.Random(3)
    rows = []
    for at in range(40):
        words = [f"w{draw.randrange(5000)}" for _ in range(120)]
        rows.append((3 * at, " ".join(words)))
        for k, changes in enumerate((2, 5)):  # one in, one out as a rule
            other = list(words)
            for i in draw.sample(range(120), changes):
                other[i] = "changed"
            rows.append((3 * at + k + 1, " ".join(other)))
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if a // 3 == b // 3 and brute_similarity(x, y) >= 0.8]
    root = {d: d for d, _ in rows}
    for _ in range(4):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    texts = dict(rows)
    apart = [bin(brute_fingerprint(texts[a]) ^ brute_fingerprint(texts[b])).count("1") for a, b in links]
    assert links and max(apart) > simhash.MAX_BITS
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs, words=5, similarity=0.8).collect()}
    assert kept == {d for d, r in root.items() if d == r}


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(shingles, "TILE", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, *[f"end{i}x{k}" for k in range(i % 3)]])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(docs, words=5, similarity=0.8).collect()] == [0]


def test_keep_one_passes_max_bits_and_words(spark):
    base = " ".join(f"w{i}" for i in range(30))
    rows = [(1, base), (2, base.replace("w15", "other"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bits = bin(brute_fingerprint(rows[0][1]) ^ brute_fingerprint(rows[1][1])).count("1")
    assert bits > 4
    assert simhash.keep_one(docs).count() == 2 and simhash.keep_one(docs, max_bits=bits).count() == 1


def test_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.where("text is not null").collect()]
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for d, w in ((d, t.lower().split()) for d, t in rows)}
    root = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(8):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    kept = corpus_pipeline.near_dedup(spark, docs.where("text is not null"), "/root/testdata/sf0.001")
    assert {r.doc_id for r in kept.collect()} == {d for d, r in root.items() if d == r}


def test_fingerprints_give_candidates_that_are_checked(spark, monkeypatch):
    """The stage joins fingerprints by the grid; sets that only these bring together are linked if they are similar."""
    seen, plain = [], simhash.with_components
    monkeypatch.setattr(simhash, "with_components", lambda marked, bits: seen.append(bits) or plain(marked, bits))
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, " ".join(f"x{i}" for i in range(60))), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3, 4] and seen == [simhash.MAX_BITS]
    marked = [(n, shingles.set_key(shingles.shingle_set(t)), [100 * n + b for b in range(shingles.BANDS)]) for n, t in rows[:3]]
    keys = [m[1] for m in marked]
    marked = staged(spark.createDataFrame(marked, "row_hash long, set_key long, cells array<long>"))
    texts = docs.withColumnRenamed("doc_id", "row_hash")
    joined = staged(spark.createDataFrame([(k, 7) for k in keys + keys[:1]], "set_key long, cell long"))
    assert shingles.link_forest(marked, texts).collect() == []
    edges = shingles.link_forest(marked, texts, joined=joined).collect()
    assert [{r.a, r.b} for r in edges] == [set(keys[:2])]
