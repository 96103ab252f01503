"""Score tiers at their limits."""

import pytest
from pyspark.sql import functions as F

from cohortspark.functions import clinical as C

N = None


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def d(x):
    return F.lit(x).cast("double")


def test_tiers(spark):
    cases = []
    cases += [(C.coagulation(d(x)), w) for x, w in [(200, 0), (150, 0), (149.9, 1), (100, 1), (99.9, 2), (49.9, 3), (19.9, 4), (N, 0)]]
    cases += [(C.liver(d(x)), w) for x, w in [(1.0, 0), (1.2, 1), (2, 2), (6, 3), (12, 4), (N, 0)]]
    cases += [(C.nervous(d(x)), w) for x, w in [(15, 0), (14, 1), (12, 2), (9, 3), (5, 4), (N, 0)]]
    cases += [(C.cardiovascular(d(m), d(v)), w) for m, v, w in [(50, N, 1), (70, N, 0), (90, 0.05, 3), (90, 0.5, 4), (N, N, 0)]]
    cases += [(C.renal(d(c), d(u), F.lit(n)), w) for c, u, n, w in [(1, 1500, 12, 0), (3.6, 1500, 12, 3), (1, 150, 12, 4), (1, 0, 0, 0), (1, 0, 3, 4)]]
    cases += [
        (C.respiration(d(p), d(f), d(s), F.lit(v)), w)
        for p, f, s, v, w in [(90, 50, N, True, 3), (90, 50, N, False, 2), (N, 50, 99, False, 2), (40, 50, N, True, 4), (N, N, N, N, 0), (450, 100, N, False, 0)]
    ]
    cases += [(C.bedside(d(r), d(g), d(b)), w) for r, g, b, w in [(22, 15, 101, 1), (21.9, 14, 101, 1), (21.9, 15, 100, 1), (30, 10, 80, 3), (N, N, N, 0)]]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [w for _, w in cases]


@pytest.mark.parametrize("age, points", [(50, 0), (51, 1), (60, 1), (61, 2), (80, 3), (81, 4), (None, 4)])
def test_age(spark, age, points):
    assert value(spark, C.age_points(F.lit(age).cast("int"))) == points


def test_first_name_wins(spark):
    names = [("SICU", 2), ("TSICU", 3)]
    assert value(spark, C.unit_code(F.lit("Trauma TSICU"), names)) == 2
    assert value(spark, C.unit_code(F.lit("ward"), names)) == 0
