"""Every query that SQL can express gives the same rows as DuckDB."""

import duckdb
import pytest

from cohortspark.llm.queries import ORACLES, QUERIES
from tests.test_queries import TABLES, plain


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in sorted(names))) for row in cursor.fetchall())
    assert sorted(repr(tuple(plain(row[c]) for c in sorted(names))) for row in df.collect()) == want


def test_the_driver_sees_every_operator():
    """A broken import in the subpackage would take all its queries away without a word."""
    import __spark_entry__

    assert __spark_entry__.HAS_LLM and set(QUERIES) <= set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{k}" for k in range(1, 14))}
