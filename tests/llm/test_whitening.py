"""Whitening against exact sums and a dense eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from cohortspark.llm import whitening
from cohortspark.llm.queries import op11_jacobi_davidson

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, components=4):
    """n, trace and, for each usable row, (vec_id, deviation, projections up to sign), by a dense eigensolver."""
    usable = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in usable})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in distinct])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    keep = e > np.trace(v) * len(v) * 2.3e-16
    e, u = e[keep], u[:, keep]
    out = []
    for i, x in usable:
        off = [n * c - s for c, s in zip(x, sums, strict=True)]
        out.append((i, sum(o * o for o in off), (np.array(off, float) / n) @ u / np.sqrt(e)))
    return n, e / np.trace(v), out


def check(got, rows):
    n, shares, want = brute(rows)
    assert len(got) == len(want) * len(shares)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
        assert r.n == n and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
    signs = {}
    for k in range(len(shares)):
        pivot = max(want, key=lambda w: abs(w[2][k]))
        signs[k] = np.sign(pivot[2][k]) * np.sign(by[pivot[0], k + 1][0].whitened)
    for i, deviation, white in want:
        for k in range(len(shares)):
            rows_of = by[i, k + 1]
            assert all(r.deviation == deviation for r in rows_of)
            assert min(abs(r.whitened - signs[k] * white[k]) for r in rows_of) < 1e-7


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op11_jacobi_davidson(spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    check(got.collect(), rows)


def test_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * [9, 5, 3, 2, 1, 1] + 40).tolist()) for i in range(60)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, None), (102, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (103, [None] * 6), (104, [float("inf")] * 6)]
    others = [(105, []), (106, [1.0, 2.0]), (107, [1e300] * 6)]  # no vector, another length, no 64-bit number
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + others], SCHEMA + ", x string, N int")
    got = whitening.whitened(docs).collect()
    check(got, rows)
    assert {r.vec_id for r in got} == {*range(60), 100}
    large = [(i, [c * 1e10 for c in v]) for i, v in rows[:60]]  # deviations beyond 64 bits are exact still
    check(whitening.whitened(spark.createDataFrame(large, SCHEMA)).collect(), large)


def test_sums_in_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(9)
    monkeypatch.setattr(whitening, "GATHERED", 0)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 5 * 8 * 7)  # seven rows a block
    check(whitening.whitened(docs).collect(), rows)


def test_few_rows(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []  # no variance
    two = [(1, [1.0, 2.0, 0.0]), (2, [3.0, 1.0, 0.0]), (None, [3.0, 1.0, 0.0])]
    got = whitening.whitened(spark.createDataFrame(two, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.component, round(abs(r.whitened), 9)) for r in got) == [("1", 1, 1), ("2", 1, 1), ("None", 1, 1)]


@pytest.mark.parametrize("kind", ["clustered", "equal", "deficient", "slow"])
def test_solver(kind):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((120, 120)))
    values = {
        "clustered": [1, 1 - 1e-7, 1 - 2e-7, 1 - 3e-7] + [0.9] * 116,
        "equal": [3.0] * 6 + [1.0] * 114,
        "deficient": [5.0, 4.0] + [0.0] * 118,
        "slow": list(1 / np.arange(1, 121) ** 0.1),
    }[kind]
    matrix = q @ np.diag(values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading_components(lambda x: matrix @ x, 120, 4)
    assert np.allclose(found, sorted(values)[::-1][:4], rtol=1e-13, atol=1e-14)
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * max(values)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13


def test_minres():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((40, 40))
    a, b = a + a.T, rng.standard_normal((40, 3))  # indefinite
    x = whitening.minres(lambda v: a @ v, b, 200, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-8
