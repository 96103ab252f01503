"""Running totals and quantiles by group against plain loops."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions.columns import to_id
from cohortspark.operators import evaluation as E
from cohortspark.operators.cohort import normal_cohort
from cohortspark.operators.ordering import group_quantiles, running_within
from cohortspark.operators.timeops import asof


def groups(seed=1):
    """One group of most rows, a null group, some of a few rows, many of one."""
    rng = random.Random(seed)
    names = ["big"] * 3000 + [None] * 50 + ["mid"] * 200 + [f"s{i}" for i in range(300)] + ["t"] * 2
    return [(g, i, rng.randrange(10), rng.choice([None, 0.5, 1.5, rng.random() * 9])) for i, g in enumerate(rng.sample(names, len(names)))]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_running_within(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = groups()
        df = spark.createDataFrame(rows, "g string, k long, n int, v double").withColumn("_kind_", F.lit("x"))
        got = {r.k: (r.run, r._kind_) for r in running_within(df, ["g"], [F.col("k").desc()], {"run": "n"}).collect()}
        total, want = defaultdict(int), {}
        for g, k, n, _ in sorted(rows, key=lambda r: -r[1]):
            total[g] += n
            want[k] = (total[g], "x")
        assert got == want
        two = running_within(df.withColumn("h", F.col("k") % 2), ["h", "g"], [F.col("k")], {"a": "n", "b": "k"}).where("g = 'big' and h = 1").agg(F.max("a"), F.max("b")).first()
        assert tuple(two) == (sum(n for g, k, n, _ in rows if g == "big" and k % 2), sum(k for g, k, _, _ in rows if g == "big" and k % 2))
        assert running_within(df.limit(0), ["g"], [F.col("k")], {"run": "n"}).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("parts", [1, 7])
def test_asof_with_one_key_of_most_rows(spark, parts):
    """Both directions, equal times, a null key, missing times and clashing names; the hot key lies in all ranges."""
    rng = random.Random(parts)
    pick = lambda: rng.choice(["hot"] * 12 + ["a", "b", None])
    left = [(pick(), rng.choice([None, *range(400)]), i) for i in range(900)]
    right = [(pick(), rng.choice([None, *range(0, 400, 3)])) for _ in range(120)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a = spark.createDataFrame([(k, None if t is None else float(t), i, "x") for k, t, i in left], "g string, at double, r long, before string")
        b = spark.createDataFrame([(k, None if t is None else float(t)) for k, t in right], "g string, at double")
        got = {r.r: (r.next_time, r.previous_time, r.before) for r in asof(a, b, "g", "at", "at").collect()}
        assert asof(a, b.limit(0), "g", "at", "at").where("next_time is null and previous_time is null").count() == len(left)
        assert asof(a.limit(0), b, "g", "at", "at").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(left)
    for k, t, i in left:
        times = [u for g, u in right if g == k and u is not None]
        after = min((u for u in times if t is not None and u >= t), default=None)
        before = max((u for u in times if t is not None and u <= t), default=None)
        assert got[i] == (after, before, "x")


def test_group_quantiles(spark):
    rows = [*groups(2), ("empty", -1, 0, None)]
    df = spark.createDataFrame(rows, "g string, k long, n int, v double")
    values = defaultdict(list)
    for g, _, _, v in rows:
        values[g] += [] if v is None else [v]
    shares = {"low": 0.0, "a": 0.25, "m": 0.5, "b": 0.9, "high": 1.0}
    got = {r.g: r for r in group_quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {r[0] for r in rows} and got["empty"].n == 0 and got["empty"].m is None
    for g, found in values.items():
        if found:
            assert got[g].n == len(found)
            assert [got[g][name] for name in shares] == pytest.approx(np.quantile(found, list(shares.values())).tolist())
    whole = group_quantiles(df, [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.median([r[3] for r in rows if r[3] is not None]))
    assert E.quantiles(df.where("v is null"), "v", [0.5]) == []


def test_metrics_by_run_have_no_window_by_run(spark):
    """A run of all rows beside small ones: the same figures as alone, and windows by range only."""
    rng = random.Random(3)
    rows = [("all", int(rng.random() < 0.3), round(rng.random(), 3)) for _ in range(4000)]
    rows += [(f"r{i % 40}", int(rng.random() < 0.5), round(rng.random(), 1)) for i in range(800)]
    df = spark.createDataFrame(rows, "run string, y int, prob double")
    got = {r.run: r.auroc for r in E.auroc(df, ["run"]).collect()}
    for run in ("all", "r0", "r7"):
        mine = [(y, p) for g, y, p in rows if g == run]
        pos, neg = [p for y, p in mine if y], [p for y, p in mine if not y]
        want = np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])
        assert got[run] == pytest.approx(want)
        one = E.pick_threshold(df.where(F.col("run") == run).select("y", "prob"), []).first().threshold
        assert E.pick_threshold(df, ["run"]).where(F.col("run") == run).first().threshold == one
    plan = E.auroc(df, ["run"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "_part" in plan and "hashpartitioning(run" not in plan.split("Window")[1]


def test_ids_are_exact(spark):
    cases = {
        "9007199254740992": 2**53, "9007199254740993": 2**53 + 1, "9007199254740993.0": 2**53 + 1, "9223372036854775807": 2**63 - 1, "9223372036854775808": None,
        "7.0": 7, "7.5": None, "1e5": 100_000, "-3": -3, "0": 0, "": None, "x": None, " 12 ": 12, "NaN": None, "inf": None, None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert [r.i for r in df.select(to_id(F.col("v")).alias("i")).collect()] == list(cases.values())
    rows = spark.createDataFrame([("9007199254740992", "1", "0"), ("9007199254740993", "1", "1"), ("9007199254740993", "2", "1")], "stay_id string, subject_id string, label string")
    assert sorted(r.stay_id for r in normal_cohort(rows).collect()) == [2**53, 2**53 + 1]
