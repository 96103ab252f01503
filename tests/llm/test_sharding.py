"""Sharding: the permutation, its inverse, and the law of row counts."""

import zlib

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import sharding
from cohortspark.llm.queries import op1_feistel_shards

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 101])
def test_permutation_and_inverse(spark, n):
    p = sharding.Permutation(spark, n, seed=n)
    rows = spark.range(n).select("id", p.position(F.col("id")).alias("at")).withColumn("back", p.row_at(F.col("at"))).collect()
    assert sorted(r["at"] for r in rows) == list(range(n))
    assert all(r["back"] == r["id"] for r in rows)


def law(rows, n):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(8)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op1_feistel_shards(spark, DATA).collect()
    law(rows, len(texts))
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    again = {r.doc_id: (r.shard, r.slot) for r in op1_feistel_shards(spark, DATA).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_order_does_not_depend_on_partitions(spark):
    docs = spark.range(97).select(F.col("id").alias("k"), (F.col("id") % 3).alias("slot"))
    one = {r.k: r.row_number for r in sharding.sharded(docs.repartition(7), ["k"]).collect()}
    assert one == {i: i for i in range(97)}
    two = sharding.sharded(docs.coalesce(1), ["k"])
    assert two.columns == ["k", "row_number", "shard", "slot"]
    p = sharding.Permutation(spark, 97)
    back = two.select("row_number", sharding.row_number_at(p, F.col("shard"), F.col("slot")).alias("b")).collect()
    assert all(r.row_number == r.b for r in back)


def test_cases(spark, tmp_path):
    rows = [(None, "a"), (None, "a"), (1, None), (1, None), (1, "b" * 100_000)] * 3
    docs = spark.createDataFrame(rows, "k long, place_in_input string")
    law(sharding.sharded(docs, ["k", "place_in_input"]).collect(), 15)
    assert sharding.sharded(docs.limit(0), ["k"]).collect() == []
    sharding.write_shards(docs, ["k"], f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 15
