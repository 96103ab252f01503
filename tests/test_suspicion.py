"""The suspicion rule on hand-built stays; hours from an origin."""

import pytest

from cohortspark.operators.cohort import suspicion

H = 3600.0

# name, antibiotics, cultures, (antibiotic, culture, suspicion) or None
CASES = [
    ("after", [100], [110], (100, 110, 100)),
    ("before", [100], [50], (100, 50, 50)),
    ("both sides: after wins", [100], [50, 110], (100, 110, 100)),
    ("nearest after", [100], [105, 118], (100, 105, 100)),
    ("nearest before", [100], [40, 95], (100, 95, 95)),
    ("24 h after is in", [100], [124], (100, 124, 100)),
    ("more is out", [100], [124.5], None),
    ("72 h before is in", [100], [28], (100, 28, 28)),
    ("more before is out", [100], [27.5], None),
    ("simultaneous", [100], [100], (100, 100, 100)),
    ("earliest wins", [200, 100], [205, 105], (100, 105, 100)),
    ("unpaired", [100], [500], None),
    ("unpaired is skipped", [100, 480], [500], (480, 500, 480)),
    ("no culture", [100], [], None),
    ("missing times", [None, 100], [None, 110], (100, 110, 100)),
]


def times(values):
    return [None if v is None else v * H for v in values]


def test_cases(spark):
    abx = [(i, t) for i, (_, a, _, _) in enumerate(CASES) for t in times(a)]
    cultures = [(i, t) for i, (_, _, c, _) in enumerate(CASES) for t in times(c)]
    got = suspicion(
        spark.createDataFrame(abx, "stay_id long, abx_time double"), spark.createDataFrame(cultures, "stay_id long, culture_time double")
    )
    found = {r.stay_id: (r.antibiotic_time / H, r.culture_time / H, r.suspicion_time / H) for r in got.collect()}
    for i, (name, _, _, want) in enumerate(CASES):
        assert found.get(i) == want, name


def test_empty(spark):
    abx = spark.createDataFrame([], "stay_id long, abx_time double")
    got = suspicion(abx, spark.createDataFrame([], "stay_id long, culture_time double"))
    assert got.columns == ["stay_id", "suspicion_time", "antibiotic_time", "culture_time"]
    assert got.collect() == []


@pytest.mark.parametrize("hours, found", [(5, False), (10, True)])
def test_limits_are_parameters(spark, hours, found):
    abx = spark.createDataFrame([(1, 100 * H)], "stay_id long, abx_time double")
    cultures = spark.createDataFrame([(1, 110 * H)], "stay_id long, culture_time double")
    assert (suspicion(abx, cultures, hours_after=hours).count() == 1) is found
