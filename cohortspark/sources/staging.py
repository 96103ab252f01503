"""Tables written between steps, where a plan must not be computed twice."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_top(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share.

    A local session without that setting gets a temporary folder; on a cluster this is an error, as its machines share none.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written below spark.checkpoint.dir and read back."""
    path = f"{shared_top(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoints(spark: SparkSession) -> None:
    """Iterative fits of this session cut their lineage below spark.checkpoint.dir."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_top(spark))
