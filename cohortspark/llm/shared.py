"""Places and texts that several operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
#: The same as a Java pattern for one or more of them.
SPACES_PATTERN = "[ \\t-\\r]+"
#: Up to so many narrow rows (some 100 bytes each), a side of a join is sent to every task.
BROADCAST_ROWS = 100_000
#: What goes to Python in one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is missing, a local session (as in tests) takes a temporary folder and keeps it as its setting;
    on a cluster this is an error, as its machines share no temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = current.rsplit("/", 1)[0] if current else f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to a shared folder and read back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows as the smaller side of a join: broadcast up to so many rows, else merged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def bounded_batches(spark: SparkSession) -> None:
    """Let the session hand Python at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` at once, as texts may be long.

    These settings hold for the session's later queries too; smaller ones are left alone.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(re.sub(r"\D", "", spark.conf.get(name)) or 0)
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of staged rows that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def word_array(text: Column) -> Column:
    """Words of a text in order (null or blank: none), inside generated code."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES_PATTERN))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later expressions read instead of computing it again in each use.

    A generator of one element: the optimizer does not merge projections across it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
