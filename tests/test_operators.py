"""Edges of the time, cohort, feature and evaluation operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortspark.functions.columns import clip, concept_name, prorated, to_id, to_number
from cohortspark.operators import cohort as C
from cohortspark.operators import evaluation as E
from cohortspark.operators import features as X
from cohortspark.operators import gates as G
from cohortspark.operators import timeops as T
from cohortspark.operators.ordering import global_running
from cohortspark.sources import tables

H = 3600.0


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    assert one(spark, to_number(F.lit("x1"))) is None and one(spark, to_number(F.lit("NaN"))) is None
    assert one(spark, to_number(F.lit(" 2.5"))) == 2.5
    assert one(spark, to_id(F.lit("30000484.0"))) == 30000484
    assert [one(spark, concept_name(F.lit(x))) for x in (" Heart Rate (bpm)", "__", None)] == ["heart_rate_bpm", "unknown", "unknown"]
    assert one(spark, prorated(F.lit(8.0), F.lit(0.0), F.lit(0.0))) == 8.0
    assert one(spark, prorated(F.lit(8.0), F.lit(1.0), F.lit(4.0))) == 2.0
    assert one(spark, clip(F.lit(float("inf")), -1, 1)) is None and one(spark, clip(F.lit(5.0), -1, 1)) == 1.0


def test_trailing_window_is_half_open(spark):
    grid = T.hour_grid(spark.createDataFrame([(1, 0.0, 30 * H)], "stay_id long, grid_start double, grid_end double"))
    events = spark.createDataFrame([(1, 0.0, 7.0), (1, -5 * H, 9.0)], "stay_id long, charttime double, value double")
    rows = {r.k: r for r in T.trailing(events, grid).collect()}
    assert len(rows) == 31
    assert rows[0].window_count == 2 and rows[18].window_count == 2 and rows[19].window_count == 1
    assert rows[23].window_max == 7.0 and rows[24].window_count == 0 and rows[24].window_max is None


def test_cohort_window_is_closed(spark):
    cohort = spark.createDataFrame([(1, 0.0, 24 * H)], "stay_id long, lower_bound double, t0 double")
    points = spark.createDataFrame([(1, 0.0), (1, 24 * H), (1, -1.0), (1, 24 * H + 1)], "stay_id long, charttime double")
    assert sorted(r.hours_before for r in T.point_window(points, cohort).collect()) == [0.0, 24.0]
    spans = [(1, -H, None), (1, -H, H), (1, 2 * H, None), (1, 5 * H, 4 * H)]
    rows = T.interval_window(spark.createDataFrame(spans, "stay_id long, starttime double, endtime double"), cohort).collect()
    assert sorted((r.observed_s, r.original_s) for r in rows) == [(0.0, 0.0), (H, 2 * H)]


def test_event_without_time_has_no_stay(spark):
    stays = spark.createDataFrame([(9, 1, 0.0, H)], "parent long, stay_id long, intime double, outtime double")
    events = spark.createDataFrame([(1, 9, None), (2, 9, 1e9), (3, 9, 5.0), (4, 8, 5.0)], "event_id long, parent long, time double")
    got = {r.event_id: r.stay_id for r in T.attribute_events(events, stays).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None}


def test_time_index(spark):
    rows = spark.createDataFrame([(0.0,), (0.99,), (23.5,), (24.0,)], "h double").select(X.time_index(F.col("h")).alias("t"))
    assert [r.t for r in rows.collect()] == [23, 23, 0, 0]


def greedy(offsets, capacities, lead):
    free, matched = sorted(capacities), []
    for o in sorted(offsets, reverse=True):
        fit = [c for c in free if c >= o + lead]
        if fit:
            free.remove(fit[-1])
            matched.append(o)
    return matched


def test_matching(spark):
    rng = random.Random(4)
    for _ in range(4):
        offsets = [float(rng.randrange(30)) for _ in range(rng.randrange(1, 12))]
        capacities = [float(rng.randrange(40)) for _ in range(rng.randrange(1, 12))]
        got = C.match_controls(
            spark.createDataFrame(list(enumerate(offsets)), "positive_id long, offset double"),
            spark.createDataFrame(list(enumerate(capacities)), "control_id long, capacity double"), 2.0,
        ).collect()
        taken = [r for r in got if r.control_id is not None]
        assert sorted(r.offset for r in taken) == sorted(greedy(offsets, capacities, 2.0))
        assert len({r.control_id for r in taken}) == len(taken)
        assert all(r.capacity >= r.offset + 2 for r in taken) and len(got) == len(offsets)


def test_global_running(spark):
    rows = spark.range(1000).select(F.col("id"), (F.hash("id") % 100).cast("long").alias("v"))
    got = {r.id: r for r in global_running(rows, [F.col("id").desc()], {"s": "v"}, {"m": "v"}).collect()}
    total, least = 0, None
    values = {r.id: r.v for r in rows.collect()}
    for i in range(999, -1, -1):
        assert got[i].m_before == least
        total, least = total + values[i], values[i] if least is None else min(least, values[i])
        assert got[i].s == total and got[i].m == least


def test_splits_keep_subjects_together(spark):
    rows = spark.createDataFrame([(i, i // 2, i % 3 == 0) for i in range(200)], "stay_id long, subject_id long, label boolean")
    rows = rows.withColumn("label", F.col("label").cast("int"))
    split = C.assign_splits(rows)
    assert split.count() == 100
    assert G.leakage(rows.join(split.drop("label"), "subject_id")).count() == 0
    assert [r.fold for r in C.grouped_folds(rows).groupBy("fold").count().orderBy("fold").collect()] == [0, 1, 2, 3, 4]


def test_metrics_against_definitions(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(2), rng.randrange(12) / 12) for i in range(150)]
    preds = spark.createDataFrame(rows, "stay_id long, y int, prob double")
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    pairs = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(E.auroc(preds, []).first().auroc, pairs)
    ap, before = 0.0, 0.0
    for t in sorted({p for _, _, p in rows}, reverse=True):
        tp, n = sum(p >= t for p in pos), sum(p >= t for _, _, p in rows)
        ap += (tp / len(pos) - before) * tp / n
        before = tp / len(pos)
    assert math.isclose(E.auprc(preds, []).first().auprc, ap)
    assert E.auroc(preds.where("y = 1"), []).first().auroc is None


def test_calibration_edges(spark):
    preds = spark.createDataFrame([(1, 0.3), (0, 0.3), (1, 1.0), (1, 0.95), (0, 0.0)], "y int, prob double")
    want = (2 * abs(0.3 - 0.5) + 2 * abs(0.975 - 1.0) + 1 * 0.0) / 5
    assert math.isclose(E.calibration_error(preds, []).first().ece, want)


@pytest.mark.parametrize("rows, want", [([(1, 2.0), (0, 2.0)], 0.0), ([(1, 3.0), (0, 2.0)], math.inf), ([(1, 3.0)], None)])
def test_mean_difference_without_spread(spark, rows, want):
    assert E.mean_difference(spark.createDataFrame(rows, "arm int, v double"), "arm", "v").first().smd == want


def test_slope_is_least_squares(spark):
    rng = random.Random(2)
    rows = [(1, "c", rng.random(), float(i)) for i in range(9)] + [(2, "c", 1.0, 3.0), (2, "c", 2.0, 3.0), (3, "c", 1.0, 1.0)]
    got = {r.stay_id: r.slope for r in X.eight_stats(spark.createDataFrame(rows, "stay_id long, concept string, value double, hours_before double")).collect()}
    xs, ys = [r[3] for r in rows[:9]], [r[2] for r in rows[:9]]
    mx, my = sum(xs) / 9, sum(ys) / 9
    assert math.isclose(got[1], sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs))
    assert got[2] is None and got[3] is None


def test_tables(spark, tmp_path):
    spark.createDataFrame([("007", 1)], "code string, n int").write.option("header", True).csv(f"{tmp_path}/c")
    assert tables.read_csv(spark, f"{tmp_path}/c", "code string, n int").first().code == "007"
    spark.range(3).write.parquet(f"{tmp_path}/late/t.parquet")
    assert tables.read_stage(spark, "t", [f"{tmp_path}/none", f"{tmp_path}/late"]).count() == 3
    assert tables.read_stage(spark, "x", [f"{tmp_path}/late"], "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_stage(spark, "x", [f"{tmp_path}/late"])
    (tmp_path / "d.json").write_text('{"hr": {"display_name": "Heart", "codes": ["1", "2"]}, "bp": {"codes": ["3"], "unit": "mm"}}')
    rows = tables.read_concepts(spark, f"{tmp_path}/d.json").orderBy("code").collect()
    assert [(r.itemid, r.concept, r.display_name, r.unit, r.category) for r in rows] == [
        (1, "hr", "Heart", "", "other"), (2, "hr", "Heart", "", "other"), (3, "bp", "bp", "mm", "other")
    ]
    tables.write_csv(spark.range(2).toDF("a"), f"{tmp_path}/out", order_by=["a"])
    assert tables.read_csv(spark, f"{tmp_path}/out", "a long", "|").count() == 2


def test_components_in_one_pass(spark):
    """Trailing sums and counts beside the worst value; a stay without events, and events that no window holds."""
    grid = T.hour_grid(spark.createDataFrame([(1, 0.0, 30 * H), (2, 0.0, 0.0)], "stay_id long, grid_start double, grid_end double"))
    rows = [(1, 0.0, 7.0), (1, -5 * H, 9.0), (1, -24 * H, 1.0), (1, 99 * H, 2.0), (1, 2 * H, None), (3, 0.0, 1.0), (None, None, None)]
    events = spark.createDataFrame(rows, "stay_id long, charttime double, value double")
    value = F.col("value")
    found = T.trailing_worst(events, grid, {"low": (value, "min"), "high": (value, "max"), "total": (value, "sum"), "n": (value, "count")})
    got = {(r.stay_id, r.k): (r.low, r.high, r.total, r.n) for r in found.collect()}
    assert len(got) == 32
    assert got[1, 0] == (7.0, 9.0, 16.0, 2) and got[1, 19] == (7.0, 7.0, 7.0, 1) and got[1, 24] == got[2, 0] == (None, None, 0.0, 0)


def test_filled_join(spark):
    left = spark.createDataFrame([(1, None, "a"), (2, 20, "b"), (3, None, "c"), (None, 4, "d")], "stay_id long, subject_id long, x string")
    right = spark.createDataFrame([(1, 10, 0.5), (2, 99, None), (None, 5, 1.0)], "stay_id long, subject_id long, y double")
    got = sorted(map(tuple, C.filled_join(left, right, "stay_id").collect()), key=str)
    assert got == sorted([(1, 10, "a", 0.5), (2, 20, "b", None), (3, None, "c", None), (None, 4, "d", None)], key=str)


def test_joined_once(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d")], "k long, x string")
    b = spark.createDataFrame([(1, 0.5), (3, 1.5)], "k long, y double")
    assert [tuple(r) for r in C.joined_once([a, b, a.select("k", F.upper("x").alias("z"))], "k").collect()] == [(1, "a", 0.5, "A")]
    assert C.joined_once([a, b.limit(0)], "k").collect() == []
    with pytest.raises(Exception, match="more than one row"):
        C.joined_once([a, b.unionByName(b.where("k = 1"))], "k").collect()
