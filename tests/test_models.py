"""Boosted fits: side by side, and by the rows' numbers alone."""

from pyspark.sql import functions as F

from cohortspark.operators import models as M


def test_boosted_fits_do_not_hang_on_partitions(spark, monkeypatch):
    """Sampled rounds give the same trees however the rows come in; each pipeline keeps its rounds."""
    monkeypatch.setattr(M, "ROWS_A_TASK", 150)
    rows = spark.range(400).select(
        F.col("id").alias("stay_id"), F.when(F.col("id") % 10 < 8, "train").otherwise("test").alias("split"),
        (F.col("id") % 7 < 3).cast("double").alias("label"), (F.col("id") % 7).cast("double").alias("x"), (F.xxhash64("id") % 100).cast("double").alias("z"),
    )
    matrix = M.with_weights(rows, ["x", "z"])
    seen = []
    for dealt in (matrix.coalesce(1), matrix.repartition(7, "z")):
        models = M.fit_all([M.boosted(["x", "z"], 2), M.boosted(["x", "z"], 3, 0.8)], dealt)
        assert [m.stages[-1].getNumTrees for m in models] == [2, 3]
        seen.append([sorted((r.stay_id, r.y, r.prob) for r in M.predict(m, matrix).collect()) for m in models])
    assert seen[0] == seen[1]
    assert all((prob > 0.5) == (y == 1) for _, y, prob in seen[0][0])
