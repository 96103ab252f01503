"""The tree of binomials draws what plain resampling draws, and its metrics are those of the drawn rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import evaluation as E
from cohortspark.operators import resampling as R


def counts_of(rows):
    """group -> counts over all replicates."""
    out = {}
    for r in sorted(rows, key=lambda r: r["chunk"]):
        key = tuple(r[c] for c in r.asDict() if c not in ("weight", "chunk", "counts"))
        out[key] = np.concatenate([out.get(key, np.zeros(0, np.int64)), np.frombuffer(r["counts"], "<i8")])
    return out


def plain_auroc(pairs):
    """By all pairs of a positive and a negative; pairs: (prob, y, count)."""
    won = sum(m * k * ((p > q) + (p == q) / 2) for p, y, m in pairs if y == 1 for q, z, k in pairs if z == 0)
    n_pos, n_neg = sum(m for _, y, m in pairs if y == 1), sum(m for _, y, m in pairs if y == 0)
    return won / (n_pos * n_neg) if n_pos and n_neg else None


@pytest.mark.parametrize(("draws", "share"), [(1, 0.5), (7, 0.3), (40, 0.999), (900, 0.37), (100_000, 1 / 3)])
def test_binomial_is_the_inverse_of_its_distribution(draws, share):
    logs = [math.lgamma(draws + 1) - math.lgamma(k + 1) - math.lgamma(draws - k + 1) + k * math.log(share) + (draws - k) * math.log(1 - share) for k in range(draws + 1)]
    upto = np.cumsum(np.exp(logs))
    u = np.random.default_rng(3).random(500)
    want = np.minimum((upto[None, :] <= u[:, None]).sum(axis=1) if draws < 10_000 else np.searchsorted(upto, u, side="right"), draws)
    got = R.binomial(np.full(500, draws), np.full(500, share), u)
    assert (got == want).mean() > 0.99 and np.abs(got - want).max() <= 1


def test_small_tables_give_the_same_draws(monkeypatch):
    rng = np.random.default_rng(4)
    draws, shares, u = rng.integers(0, 5000, 300), rng.choice([0.1, 0.5, 0.9], 300), rng.random(300)
    whole = R.binomial(draws, shares, u)
    monkeypatch.setattr(R, "_TABLE", 2000)
    assert (R.binomial(draws, shares, u) == whole).all()


def test_counts_are_multinomial(spark):
    # 700 groups, two steps of the tree; one group holds a third of all rows.
    rows = spark.range(1050).selectExpr("case when id < 350 then 0.5D else id / 2000.0D end as prob", "cast(id % 3 = 0 as int) as y")
    found = counts_of(R.resampled(rows, ["prob", "y"], 600, 9).collect())
    weights = {}
    for r in rows.collect():
        weights[(r.prob, r.y)] = weights.get((r.prob, r.y), 0) + 1
    assert found.keys() == weights.keys()
    table = np.stack([found[k] for k in weights])
    assert (table.sum(axis=0) == 1050).all()
    w = np.array(list(weights.values()))
    sd = np.sqrt(w * (1 - w / 1050))
    assert np.abs((table.mean(axis=1) - w) / (sd / math.sqrt(600))).max() < 5
    ratio = table.var(axis=1) / sd**2
    assert 0.98 < ratio.mean() < 1.02 and ratio.min() > 0.7 and ratio.max() < 1.4
    singles = np.corrcoef(table[w == 1][:60])
    assert abs(singles[np.triu_indices(60, 1)].mean() + 1 / 1050) < 0.01
    again = counts_of(R.resampled(rows.repartition(5), ["prob", "y"], 600, 9).collect())
    assert all((again[k] == found[k]).all() for k in found)


def test_metrics_are_those_of_the_drawn_rows(spark):
    rows = spark.range(90).selectExpr("(id * 37 % 11) / 10.0D as prob", "if(id % 13 = 0, null, (id * 17 % 23) / 22.0D) as other", "cast(id * 7 % 5 < 2 as int) as y")
    counted = R.resampled(rows, ["prob", "other", "y"], 260, 1)
    found = counts_of(counted.collect())
    got = {(r.model, r.replicate): r.metric for r in R.replicate_auroc(counted, {"a": "prob", "b": "other"}).collect()}
    assert len(got) == 2 * 260
    for rep in (0, 100, 249, 250, 259):
        for model, at in (("a", 0), ("b", 1)):
            pairs = [(-1.0 if k[at] is None else k[at], k[2], int(v[rep])) for k, v in found.items()]
            assert got[model, rep] == pytest.approx(plain_auroc(pairs), abs=1e-12)
    precision = {(r.model, r.replicate): r.auprc for r in E.auprc(R.replicate_rows(counted, {"a": "prob", "b": "other"}), ["model", "replicate"], "times").collect()}
    again = {(r.model, r.replicate): r.auroc for r in E.auroc(R.replicate_rows(counted, {"a": "prob"}), ["model", "replicate"], "times").collect()}
    assert all(again["a", rep] == pytest.approx(got["a", rep], abs=1e-12) for rep in range(260))
    for rep in (3, 251):
        drawn = sorted(((k[0], k[2], int(v[rep])) for k, v in found.items()), reverse=True)
        n_pos, area = sum(m for _, y, m in drawn if y == 1), 0.0
        for p in {p for p, _, _ in drawn}:
            above = [(y, m) for q, y, m in drawn if q >= p]
            here = sum(m for q, y, m in drawn if q == p and y == 1)
            area += here * sum(m for y, m in above if y == 1) / max(1, sum(m for _, m in above))
        assert precision["a", rep] == pytest.approx(area / n_pos, abs=1e-12)
    rates = {(r.rate, r.replicate): r.metric for r in R.replicate_rates(counted, {"se": ((F.col("other") >= 0.5) & (F.col("y") == 1), F.col("y") == 1)}).collect()}
    for rep in (0, 255):
        hits = sum(v[rep] for k, v in found.items() if k[2] == 1 and (k[1] or 0) >= 0.5)
        assert rates["se", rep] == pytest.approx(hits / sum(v[rep] for k, v in found.items() if k[2] == 1))


def test_empty_single_and_one_class(spark):
    schema = "prob double, y int"
    assert R.resampled(spark.createDataFrame([], schema), ["prob", "y"], 10).collect() == []
    one = R.resampled(spark.createDataFrame([(0.5, 1), (0.5, 1), (None, None)], schema), ["prob", "y"], 10)
    assert [r.weight for r in one.collect()] == [2]
    assert {r.metric for r in R.replicate_auroc(one, {"a": "prob"}).collect()} == {None}
    none = spark.createDataFrame([(None, 1), (0.2, 0)], schema)
    values = {r.metric for r in R.replicate_auroc(R.resampled(none, ["prob", "y"], 40), {"a": "prob"}).collect()}
    assert values == {0.0, None}


def test_terms_one_by_one_and_by_table_agree(monkeypatch):
    rng = np.random.default_rng(5)
    draws, shares, u = rng.integers(0, 300, 2000), rng.choice([0.01, 0.5, 2 / 3, 0.9999], 2000), rng.random(2000)
    few = R.binomial(draws, shares, u)
    monkeypatch.setattr(R, "_FEW", -1)
    assert (R.binomial(draws, shares, u) == few).all()


def test_vectors_take_the_narrowest_width():
    counts = np.array([[0, 255], [1, 256], [70_000, 2], [2**33, 0], [3, 3]])
    seen = {}
    for rows, vectors in R.packed(counts):
        assert (R.unpacked(vectors, False) == counts[rows]).all()
        seen |= {int(r): len(v.as_py()) for r, v in zip(rows, vectors, strict=True)}
    assert [seen[i] for i in range(5)] == [3, 5, 9, 17, 3]


def test_drawn_vectors_are_narrow_and_give_the_same_metrics(spark):
    rows = spark.range(400).selectExpr("if(id % 50 = 0, null, id * 37 % 397 / 400.0D) as prob", "id * 17 % 23 / 22.0D as other", "cast(id * 7 % 5 < 2 as int) as y")
    table, models = R.drawn(rows, ["prob", "other", "y"], 260, 1), {"a": "prob", "b": "other"}
    assert {len(r.packed) for r in table.collect()} == {1 + 250, 1 + 10}
    wide = R.resampled(rows, ["prob", "other", "y"], 260, 1)
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(R.replicate_auroc(table, models)) == order(R.replicate_auroc(wide, models))
    rates = {"se": ((F.col("other") >= 0.5) & (F.col("y") == 1), F.col("y") == 1), "share": (F.col("y") == 1, F.lit(True))}
    assert order(R.replicate_rates(table, rates)) == order(R.replicate_rates(wide, rates))
    assert R.replicate_rows(table, models).exceptAll(R.replicate_rows(wide, models)).count() == 0
