"""The bundle against the grids of single concepts, its errors and empty parts."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortspark.operators import bundle as B
from cohortspark.operators import features as X

ROWS = [
    (1, "hr", 80.0, 23.5), (1, "hr", 90.0, 23.1), (1, "hr", 70.0, 2.0), (2, "hr", 60.0, 0.0), (3, "hr", 100.0, 5.0), (9, "hr", 1.0, 1.0),
    (1, "fluid", 100.0, 3.5), (1, "fluid", 50.0, 3.2), (2, "fluid", -5.0, 1.0), (1, "other", 3.0, 1.0), (2, "hr", None, 4.0),
]


@pytest.fixture
def parts(spark):
    rows = spark.createDataFrame(ROWS, "stay_id long, concept string, value double, hours_before double")
    cohort = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (None, 1)], "stay_id long, label int")
    static = spark.createDataFrame([(1, 60.0, 1), (2, None, 1), (3, 40.0, 1), (8, 7.0, 5)], "stay_id long, age double, constant int")
    return rows, cohort, static, cohort.where("stay_id in (1, 2)")


def test_same_as_the_grids(spark, parts):
    rows, cohort, static, train = parts
    modalities = {"a": B.Modality(rows, ("hr", "none")), "b": B.Modality(rows, ("fluid",), frozenset(["fluid"]))}
    bundle = B.grid_bundle(cohort, modalities, static, train)
    cells = {(r.stay_id, r.unit, r.t): (r.value, r.mask, r.delta) for r in B.bundle_cells(bundle, modalities).collect()}
    assert len(cells) == 4 * (24 * 3 + 1) and bundle.static_columns == ["age"]
    real = cohort.where("stay_id is not null")
    for grid, concept in ((X.grid_point, "hr"), (X.grid_cumulative, "fluid")):
        of = spark.createDataFrame([(concept,)], "concept string")
        for r in grid(rows.where(F.col("concept") == concept).where("value is not null"), real, of, train).collect():
            assert cells[r.stay_id, concept, r.t] == (pytest.approx(r.value), r.mask, pytest.approx(r.delta))
    assert cells[4, "none", 0] == (0, 0, 1) and cells[1, "hr", 0][1] == 1
    shapes = bundle.rows.select(F.size("a"), F.size(F.col("a")[0]), F.size("b"), F.size(F.col("b")[23]), "label", "in_train", "stay_id").collect()
    assert {tuple(r)[:4] for r in shapes} == {(24, 6, 24, 3)} and {r.stay_id for r in shapes if r.in_train} == {1, 2}


def test_static_block_and_subset(spark, parts):
    rows, cohort, static, _ = parts
    bundle = B.grid_bundle(cohort, {"a": B.Modality(rows, ("hr",))}, static, cohort.where("stay_id in (1, 3)"), cohort.where("stay_id <> 2"))
    found = {r.stay_id: r.static for r in bundle.rows.collect()}
    assert bundle.static_columns == ["age"] and bundle.static_scale == [(50.0, 10.0)]
    assert found == {1: [1.0], 3: [-1.0], 4: [0.0]}  # a stay without static row takes the mean
    assert bundle.scale["a"]["hr"][0] == pytest.approx((80 + 90 + 70 + 100) / 4)
    plan = bundle.rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "Generate" not in plan


def test_errors(spark, parts):
    rows, cohort, static, train = parts
    with pytest.raises(ValueError, match="training"):
        B.grid_bundle(cohort, {}, static, cohort.where("stay_id = 77"))
    late = rows.union(spark.createDataFrame([(1, "hr", 1.0, -0.5)], rows.schema))
    with pytest.raises(PySparkException):
        B.grid_bundle(cohort, {"a": B.Modality(late, ("hr",))}, static, train).rows.collect()
