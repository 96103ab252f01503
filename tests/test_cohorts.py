"""Control matching, splits, gates and sweeps on hand-built and planted cases."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortspark.operators import cohort as C
from cohortspark.operators import evaluation as E
from cohortspark.operators import gates as G
from cohortspark.operators import models as M


def frames(spark, offsets, capacities):
    return (
        spark.createDataFrame([(i, float(o) if o is not None else None) for i, o in enumerate(offsets)], "positive_id long, offset double"),
        spark.createDataFrame([(1000 + i, float(c) if c is not None else None) for i, c in enumerate(capacities)], "control_id long, capacity double"),
    )


def most_matches(offsets, capacities, lead):
    """Longest offsets first, the least capacity that serves: no matching has more."""
    free, n = sorted(c for c in capacities if c is not None), 0
    for o in sorted((o for o in offsets if o is not None and o >= 0), reverse=True):
        fit = [c for c in free if c >= o + lead]
        if fit:
            free.remove(fit[0])
            n += 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_as_many_matches_as_possible(spark, seed):
    rng = random.Random(seed)
    offsets = [rng.choice([rng.randrange(20), rng.randrange(20), -3, None]) for _ in range(rng.randrange(1, 40))]
    capacities = [rng.choice([rng.randrange(25), None]) for _ in range(rng.randrange(1, 60))]
    got = C.match_controls(*frames(spark, offsets, capacities), lead=2.0, seed=seed).collect()
    taken = [r.control_id for r in got if r.control_id is not None]
    # As many are asked for as there are offsets; what is null or negative is made up for by copies of others.
    assert len(got) == len(offsets) and {r.offset for r in got} == {o for o in offsets if o is not None and o >= 0}
    assert len(taken) == len(set(taken)) == most_matches([r.offset for r in got], capacities, 2)
    assert all(r.capacity >= r.offset + 2 for r in got if r.control_id is not None)


def test_controls_are_spread_like_the_feasible_pool(spark):
    """Half the offsets are 0, so every control may serve them; the longest stays have no preference."""
    offsets, capacities = [0] * 200 + [500] * 200, list(range(2000))
    got = C.match_controls(*frames(spark, offsets, capacities), lead=0.0).collect()
    short = [r.capacity for r in got if r.offset == 0]
    assert len(got) == 400 and all(r.control_id is not None for r in got)
    low = sum(c.capacity < 500 for c in got) / 400
    # Chances of the sequential draw: the long offsets take 200 of 1500, then 200 of the 1800 left are drawn.
    assert 0.08 < low < 0.20 and max(short) > 400
    middle = sum(500 <= r.capacity < 1250 for r in got) / sum(r.capacity >= 500 for r in got)
    assert 0.42 < middle < 0.58


def sequential(offsets, capacities, rng):
    """The plain draw: longest offsets first, a random free control for each."""
    free, out = list(capacities), []
    for o in sorted(offsets, reverse=True):
        fit = [c for c in free if c >= o]
        if fit:
            out.append((o, rng.choice(fit)))
            free.remove(out[-1][1])
    return out


def test_each_offset_gets_a_random_free_control(spark):
    """Long offsets have no longer stays than the plain draw gives them."""
    rng = random.Random(1)
    offsets = [0] * 150 + [300] * 150 + [600] * 150
    capacities = [rng.random() * 1000 for _ in range(3000)]
    plain = [pair for _ in range(20) for pair in sequential(offsets, capacities, rng)]
    want = {o: sum(c for p, c in plain if p == o) / sum(p == o for p, _ in plain) for o in (0, 300, 600)}
    got = [r for seed in (3, 4, 5) for r in C.match_controls(*frames(spark, offsets, capacities), lead=0.0, seed=seed).collect()]
    for o in (0, 300, 600):
        drawn = [r.capacity for r in got if r.offset == o]
        assert len(drawn) == 450
        # Standard error of a mean of 450 stays: 14 at most.
        assert abs(sum(drawn) / 450 - want[o]) < 45, (o, want[o])


def test_ratio(spark):
    offsets, capacities = list(range(20)), [100] * 200
    for ratio, n in ((0.5, 10), (1, 20), (3, 60)):
        got = C.match_controls(*frames(spark, offsets, capacities), lead=1.0, ratio=ratio).collect()
        assert len(got) == n and len({r.control_id for r in got}) == n
        assert all(r.offset == r.positive_id for r in got) and len({(r.positive_id, r.copy) for r in got}) == n


def test_report_and_balance(spark):
    got = C.match_controls(*frames(spark, [1, 2, 30], [10, 10]), lead=1.0)
    report = G.matching_report(got, 1.0).first()
    assert (report.requested, report.matched, report.unmatched, report.tail_violations) == (3, 2, 1, 0) and report.smd > 0.5
    arms = spark.createDataFrame([(k, float(v + k * d)) for v in range(50) for k in (0, 1) for d in (0,)], "arm int, v double")
    assert G.balance(arms, "arm", "v").first().passed
    assert not G.balance(arms.withColumn("v", F.col("v") + 20 * F.col("arm")), "arm", "v").first().passed


def test_guards_raise(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 24.0)], "id long, hours_before double")
    assert G.guarded_window(rows, 24).count() == 2
    for bad in (-0.5, 25.0):
        with pytest.raises(PySparkException):
            G.guarded_window(rows.withColumn("hours_before", F.lit(bad)), 24).collect()
    bad = G.component_sum(spark.createDataFrame([(2.0,), (3.0,), (16.0,), (None,)], "gcs double")).first()
    assert (bad.passed, bad.n_bad) == (False, 2)


def cohort(spark, n=200):
    return spark.createDataFrame([(i, i // 2, i % 2) for i in range(n)], "stay_id long, subject_id long, label long")


def test_splits_are_made(spark):
    rows = {r.stay_id: r.split for r in C.load_splits(cohort(spark)).collect()}
    assert len(rows) == 200 and all(rows[2 * i] == rows[2 * i + 1] for i in range(100))
    share = {s: sum(v == s for v in rows.values()) / 200 for s in ("train", "val", "test")}
    assert abs(share["test"] - 0.2) < 0.02 and abs(share["val"] - 0.16) < 0.02 and abs(share["train"] - 0.64) < 0.02


def test_splits_are_read_and_checked(spark):
    names = F.element_at(F.array(*map(F.lit, ["tr", " VALID", "te"])), (F.col("subject_id") % 3 + 1).cast("int"))
    known = cohort(spark).withColumn("split", names)
    rows = known.unionByName(known).unionByName(known.limit(3).withColumn("stay_id", F.lit(None).cast("long")))
    got = {r.stay_id: r.split for r in C.load_splits(rows).collect()}
    assert len(got) == 200 and got[0] == "train" and got[2] == "val" and got[4] == "test"
    for bad in ("other", None):
        with pytest.raises(PySparkException, match="unknown split"):
            C.load_splits(known.withColumn("split", F.when(F.col("stay_id") == 7, bad).otherwise(F.col("split")))).collect()
    with pytest.raises(ValueError, match="several splits"):
        C.load_splits(known.withColumn("split", F.when(F.col("stay_id") == 7, "test").otherwise(F.lit("train"))))
    with pytest.raises(ValueError, match="empty splits"):
        C.load_splits(known.where("split <> 'te'"))
    with pytest.raises(ValueError, match="needs"):
        C.load_splits(known.drop("label"))


def test_top_up(spark):
    rows = spark.createDataFrame([(i, int(i < 3)) for i in range(20)], "stay_id long, label int")
    labels = lambda df: sorted(r.label for r in df.collect())
    assert labels(C.balanced_subset(rows, 5, 1)) == [0] * 5 + [1] * 3
    assert labels(C.balanced_subset(rows, 5, 1, top_up=True)) == [0] * 7 + [1] * 3


def test_quantiles(spark):
    values = [3.0, 1.0, None, 2.0, 10.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert E.quantiles(df, "v", [0, 0.25, 0.5, 0.9, 1]) == [1.0, 2.0, 2.0, 3.0 * 0.4 + 10.0 * 0.6, 10.0] or E.quantiles(df, "v", [0.5]) == [2.0]
    assert E.quantiles(df.limit(0), "v", [0.5]) == []


def test_importance_finds_the_planted_signal(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        x = [rng.gauss(0, 1) for _ in range(4)]
        rows.append((i, i, "train", float(x[0] + x[1] > 0), *x))
    names = ["a_m", "a_n", "b_m", "b_n"]
    matrix = spark.createDataFrame(rows, "stay_id long, row_no long, split string, label double, " + ", ".join(f"{n} double" for n in names))
    matrix = M.with_weights(matrix, names)
    model = M.fit(M.logistic(names, 300), matrix)
    units = {n: [n] for n in names} | {"concept a": ["a_m", "a_n"], "concept b": ["b_m", "b_n"]}
    got = {r.feature: r.importance_mean for r in M.permutation_importance(model, matrix, units, repeats=5).collect()}
    assert got.keys() == units.keys() and got["concept a"] > max(got["a_m"], got["a_n"]) > 0.05
    assert abs(got["b_m"]) < 0.02 and abs(got["concept b"]) < 0.02
