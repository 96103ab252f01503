"""Every query with SQL gives the same rows as DuckDB."""

import datetime
import decimal

import duckdb
import pytest

from cohortspark.plans.all_queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return float(f"{float(v):.9g}")
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in order)) for row in cursor.fetchall())
    got = sorted(repr(tuple(plain(row[c]) for c in order)) for row in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_models_score_every_run(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert rows
    for r in rows:
        assert all(v is None or isinstance(v, str) or -1 <= v <= 1 for v in r)
    if name == "logreg_sweep":
        assert len({r.run for r in rows}) == 11 and [r.run for r in rows if r.error] == ["empty"]
