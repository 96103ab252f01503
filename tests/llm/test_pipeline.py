"""The pipeline's stages against plain versions, each judged on its own input."""

import struct

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortspark.llm import mixing, quality, secrets
from tests.llm.test_shingles import brute_similarity

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "secrets", "mixing", "bpe"]

    kept = corpus_pipeline.staged(stages["quality"](spark, docs, DATA))
    assert kept.columns == columns
    judged = quality.judge(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("kept")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged.collect()}

    unique = corpus_pipeline.staged(stages["near_dedup"](spark, kept, DATA))
    texts = {r.doc_id: r.text for r in kept.collect()}
    root = {d: d for d in texts}
    links = [(a, b) for a in texts for b in texts if a < b and brute_similarity(texts[a], texts[b]) >= 0.8]
    for _ in range(8):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert unique.columns == columns
    assert sorted(r.doc_id for r in unique.collect()) == sorted(d for d, r in root.items() if d == r)

    masked = corpus_pipeline.staged(stages["secrets"](spark, unique, DATA))
    assert masked.columns == columns
    before = {r.doc_id: r for r in unique.collect()}
    for r in masked.collect():
        assert r.text == secrets.masked(before[r.doc_id].text) and not secrets.find(r.text)
        assert r.n_chars == (len(r.text) if r.text != before[r.doc_id].text else before[r.doc_id].n_chars)

    mixed = corpus_pipeline.staged(stages["mixing"](spark, masked, DATA))
    copies, _ = mixing.mix(masked)
    want = {r.doc_id: r.copies for r in copies.where("copies > 0").collect()}
    assert mixed.columns == columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in stages["bpe"](spark, mixed, DATA).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)


def test_run_on_odd_rows(spark, tmp_path):
    words = " ".join(f"word{i} of the" for i in range(60))
    rows = [(1, words, "en", "a", 9), (1, words, "en", "a", 9), (2, words, None, "a", None), (None, None, None, None, None), (3, "", "en", "b", 0), (None, words + " more", "en", None, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/d/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/d/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/d")
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert got.select("doc_id").distinct().count() == 1 and got.count() >= 1
    rest = spark.read.parquet(f"{tmp_path}/d/documents.parquet")  # the stages after the filter, on all odd rows
    for _, stage in corpus_pipeline.STAGES[1:]:
        rest = corpus_pipeline.staged(stage(spark, rest, f"{tmp_path}/d"))
    assert {r.doc_id for r in rest.collect()} <= {1, 3, None} and rest.where("doc_id = 1").count() >= 1
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/e/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").where(F.lit(True)).collect() == []
