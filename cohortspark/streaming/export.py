"""Incremental export of event files against a fixed cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.columns import epoch_seconds
from cohortspark.operators.timeops import point_window


def points_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("stay_id"), epoch_seconds(F.col("ts")).alias("charttime"), F.col("event_type").alias("concept"), "value", "event_id"
    )


def stream_export(spark: SparkSession, source: str, schema, cohort: DataFrame, target: str, checkpoint: str) -> None:
    """Append the window rows of every file below ``source`` that is not exported yet, then stop.

    A stream-static join without state, so there is no watermark; the rows are those of the batch export.
    """
    events = spark.readStream.schema(schema).parquet(source)
    rows = point_window(points_of(events), cohort)
    query = (
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
