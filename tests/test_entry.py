"""The driver's entry points, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "stay_id" and len(df.columns) == 41 and df.count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_import_the_subpackage():
    code = "import sys, cohortspark.plans.all_queries as a; print(len(a.QUERIES), any(m.startswith('cohortspark.llm') for m in sys.modules))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) >= 80 and out[-1] == "False"
