"""Reading, writing and auditing the tables of a stage."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.sources.staging import pinned


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, separator: str = ",") -> DataFrame:
    """A delimited file with a header under a declared schema (codes keep leading zeros)."""
    return spark.read.schema(schema).option("header", True).option("sep", separator).csv(path)


def write_csv(df: DataFrame, path: str, separator: str = "|", order_by: list[str] | None = None) -> None:
    """A delimited file with a header, for exchange; sorted only if asked."""
    ordered = df.orderBy(*order_by) if order_by else df
    ordered.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_stage(spark: SparkSession, name: str, stages: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """The table from the first (most processed) stage that has it.

    With a schema the table is optional: one that no stage has is empty, with a warning; without one it is an error.
    """
    for stage in stages:
        path = f"{stage}/{name}.parquet"
        if table_exists(spark, path):
            return spark.read.parquet(path)
    if schema is None:
        raise FileNotFoundError(f"no stage has {name}")
    warnings.warn(f"optional table {name} is missing; what is made of it counts as none", stacklevel=2)
    return spark.createDataFrame([], schema)


def write_stage(folder: str, tables: dict[str, DataFrame], only: list[str] | None = None) -> None:
    """The tables of a stage, each in a folder of its own; ``only`` names those to write again, the rest stay."""
    for name, df in tables.items():
        if only is None or name in only:
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def split_scan(rows: DataFrame, outputs: dict[str, tuple[Column, Callable[[DataFrame], DataFrame]]]) -> dict[str, DataFrame]:
    """Several outputs (a filter and a projection each) of rows that are filtered and written once."""
    once = pinned(rows)
    return {name: project(once.where(wanted)) for name, (wanted, project) in outputs.items()}


def append_all(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """The rows of all parts under one column order; a column that a part lacks is null."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for name in columns:
        if name not in merged.columns:  # a column that no part has
            merged = merged.withColumn(name, F.lit(None).cast("string"))
    return merged.select(*columns)


def audit_columns(spark: SparkSession, tables: dict[str, DataFrame | None], required: dict[str, list[str]]) -> DataFrame:
    """(table_name, status, missing) for each contract: ok, incomplete or absent."""
    rows = []
    for name, columns in required.items():
        df = tables.get(name)
        missing = sorted(columns if df is None else set(columns) - set(df.columns))
        rows.append((name, "absent" if df is None else "incomplete" if missing else "ok", ",".join(missing)))
    return spark.createDataFrame(rows, "table_name string, status string, missing string")


def audit_values(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """(table_name, column_name, n_missing, n) over whole tables; one pass a table."""
    out = []
    for name, columns in required.items():
        df = tables[name]
        missing = [(F.count_if(F.col(c).isNull()) if c in df.columns else F.count("*")).alias(c) for c in columns]
        row = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns])
        counted = df.agg(*missing, F.count("*").alias("n_rows")).select(F.explode(row).alias("r"), "n_rows")
        out.append(counted.select(F.lit(name).alias("table_name"), "r.column_name", "r.n_missing", F.col("n_rows").alias("n")))
    return reduce(lambda a, b: a.unionByName(b), out)


def concept_ids(flat: DataFrame) -> DataFrame:
    """The sorted set of item ids of each category of a flattened dictionary."""
    return flat.where("itemid is not null").groupBy("category").agg(F.array_sort(F.collect_set("itemid")).alias("ids"))


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file (concept -> display_name, unit, category, codes) as one row per concept and code."""
    entry = "struct<display_name:string,unit:string,category:string,codes:array<string>>"
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("concept", "e"))
    return flatten_concepts(parsed.select("concept", "e.*"))


def flatten_concepts(concepts: DataFrame) -> DataFrame:
    """One row per code; a missing name is the concept, a missing unit empty, a missing category ``other``."""
    return concepts.select(
        F.explode("codes").alias("code"),
        "concept",
        F.coalesce("display_name", "concept").alias("display_name"),
        F.coalesce("unit", F.lit("")).alias("unit"),
        F.coalesce("category", F.lit("other")).alias("category"),
    ).withColumn("itemid", F.col("code").try_cast("bigint"))


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions (ablation, model, seed, split, stay_id, y, prob) by run."""
    df.write.mode("overwrite").partitionBy("ablation", "model", "seed").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    schema = "split string, stay_id bigint, y int, prob double, ablation string, model string, seed int"
    return spark.read.schema(schema).parquet(path)


def run_index(predictions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Predictions of the run behind each reported row: that of its median seed, else the one without seed."""
    runs = predictions.select("ablation", "model", "seed").distinct()
    wanted = metrics.select("ablation", "model", F.col("median_seed").alias("wanted"))
    found = runs.join(wanted, ["ablation", "model"])
    rank = F.when(F.col("seed") == F.col("wanted"), 0).when(F.col("seed").isNull() | (F.col("seed") < 0), 1)
    best = found.where(rank.isNotNull()).groupBy("ablation", "model").agg(F.min_by("seed", rank).alias("chosen"))
    joined = predictions.join(best, ["ablation", "model"])
    return joined.where(F.col("seed").eqNullSafe(F.col("chosen"))).drop("chosen")
