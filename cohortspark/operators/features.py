"""Summary features per entity and hourly grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.sources.staging import pinned

STATS = ("count", "present", "last", "min", "max", "mean", "std", "slope")


def eight_stats(rows: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Eight statistics per stay and concept of rows (stay_id, concept, value, hours_before).

    ``last`` is the value nearest to the prediction; ``tie`` columns order equal times. The slope is that of the value
    over hours_before, null below two points or without spread in time.
    """
    order = F.struct("hours_before", *(tie or []), "value")
    fit = rows.where(F.col("value").isNotNull() & F.col("hours_before").isNotNull())
    return fit.groupBy("stay_id", "concept").agg(
        F.count("value").alias("count"),
        F.lit(1).alias("present"),
        F.min_by("value", order).alias("last"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.regr_slope("value", "hours_before").alias("slope"),
    )


def wide(stats: DataFrame, cohort: DataFrame, concepts: list[str], names: list[str] = list(STATS)) -> DataFrame:
    """One row per cohort stay, a column ``<concept>__<stat>`` each; the concepts are given, so nothing is scanned for them."""
    pivoted = stats.groupBy("stay_id").pivot("concept", concepts).agg(*[F.first(n).alias(n) for n in names])
    renamed = pivoted.select("stay_id", *[F.col(f"`{c}_{n}`").alias(f"{c}__{n}") for c in concepts for n in names])
    return cohort.select("stay_id").join(renamed, "stay_id", "left")


def fill_structural_zeros(matrix: DataFrame, sums: list[str] = ()) -> DataFrame:
    """Null to 0 where absence means none: counts, presence flags and the named sums; other columns keep null."""
    zero = [c for c in matrix.columns if c.endswith(("__count", "__present")) or c in sums]
    return matrix.fillna(0, subset=zero) if zero else matrix


def treatment_summary(rows: DataFrame) -> DataFrame:
    """Per stay: total fluid, mean and largest pressor rate, urine total; null where there were no such rows."""
    of = lambda concept: F.when(F.col("concept") == concept, F.col("value"))
    return rows.groupBy("stay_id").agg(
        F.sum(of("fluid")).alias("fluid_total"),
        F.avg(of("vasopressor")).alias("vasopressor_mean"),
        F.max(of("vasopressor")).alias("vasopressor_max"),
        F.sum(of("urine")).alias("urine_total"),
    )


def one_hot(df: DataFrame, column: str, levels: list) -> DataFrame:
    """A 0/1 column for each level and one for null."""
    flags = {f"{column}__{level}": F.when(F.col(column) == level, 1).otherwise(0) for level in levels}
    return df.withColumns(flags | {f"{column}__missing": F.col(column).isNull().cast("int")})


def varying_columns(matrix: DataFrame, train: Column) -> list[str]:
    """Columns with two values or more among the training rows (null counts as a value)."""
    names = [c for c in matrix.columns if c != "stay_id"]
    fit = matrix.where(train)
    sums = []
    for c in names:
        kinds = (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))
        sums.append(F.coalesce(kinds, F.lit(False)).alias(c))
    row = fit.agg(*sums).first()
    return [c for c in names if row[c]]


def train_scale(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Mean and population standard deviation of each concept on training stays; 0 and 1 where they do not exist."""
    fit = rows.join(train.select("stay_id"), "stay_id", "left_semi")
    scale = fit.groupBy("concept").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    sd = F.when(F.coalesce("sd", F.lit(0.0)) < 1e-8, 1.0).otherwise(F.col("sd"))
    return scale.select("concept", F.coalesce("mu", F.lit(0.0)).alias("mu"), sd.alias("sd"))


def time_index(hours_before: Column, bins: int = 24) -> Column:
    """Chronological hour of an event: the oldest is 0, the last before the prediction ``bins`` - 1."""
    bin_ = F.least(F.greatest(F.floor(hours_before), F.lit(0)), F.lit(bins - 1))
    return (bins - 1 - bin_).cast("int")


def skeleton(cohort: DataFrame, concepts: DataFrame, bins: int = 24) -> DataFrame:
    """Every stay, concept and hour."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("t")
    return cohort.select("stay_id").join(F.broadcast(concepts.select("concept"))).select("*", hours)


def grid_point(rows: DataFrame, cohort: DataFrame, concepts: DataFrame, train: DataFrame, bins: int = 24) -> DataFrame:
    """Point-in-time concepts on the hourly grid: value (z-scored, carried forward), mask and delta."""
    scale = train_scale(rows, train)
    hourly = rows.groupBy("stay_id", "concept", time_index(F.col("hours_before"), bins).alias("t")).agg(F.avg("value").alias("v"))
    full = skeleton(cohort, concepts, bins).hint("merge").join(hourly, ["stay_id", "concept", "t"], "left")
    full = full.join(F.broadcast(scale), "concept", "left")
    frame = Window.partitionBy("stay_id", "concept").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    mu, sd = F.coalesce("mu", F.lit(0.0)), F.coalesce("sd", F.lit(1.0))
    carried = F.coalesce(F.last("v", ignorenulls=True).over(frame), mu)
    seen = F.max(F.when(F.col("v").isNotNull(), F.col("t"))).over(frame)
    delta = F.least(F.coalesce(F.col("t") - seen, F.lit(bins)), F.lit(bins)) / F.lit(float(bins))
    return full.select(
        "stay_id", "concept", "t", ((carried - mu) / sd).alias("value"), F.col("v").isNotNull().cast("int").alias("mask"), delta.alias("delta")
    )


def grid_cumulative(rows: DataFrame, cohort: DataFrame, concepts: DataFrame, train: DataFrame, bins: int = 24) -> DataFrame:
    """Cumulative concepts on the grid: hourly sums (0 where none), log1p, z-scored over all training hours."""
    hourly = rows.groupBy("stay_id", "concept", time_index(F.col("hours_before"), bins).alias("t")).agg(F.sum("value").alias("v"))
    full = skeleton(cohort, concepts, bins).hint("merge").join(hourly, ["stay_id", "concept", "t"], "left")
    full = pinned(full.withColumn("x", F.log1p(F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0)))))  # scaled, then read again
    scale = train_scale(full.select("stay_id", "concept", F.col("x").alias("value")), train)
    full = full.join(F.broadcast(scale), "concept", "left")
    frame = Window.partitionBy("stay_id", "concept").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.when(F.col("v").isNotNull(), F.col("t"))).over(frame)
    delta = F.least(F.coalesce(F.col("t") - seen, F.lit(bins)), F.lit(bins)) / F.lit(float(bins))
    mu, sd = F.coalesce("mu", F.lit(0.0)), F.coalesce("sd", F.lit(1.0))
    return full.select(
        "stay_id", "concept", "t", ((F.col("x") - mu) / sd).alias("value"), F.col("v").isNotNull().cast("int").alias("mask"), delta.alias("delta")
    )


def packed_grid(grid: DataFrame, concepts: list[str]) -> DataFrame:
    """One row per stay: for each hour an array of value, mask and delta of each concept in the given order."""
    order = F.array_position(F.array(*map(F.lit, concepts)), F.col("concept"))
    cells = grid.where(order > 0).groupBy("stay_id", "t").agg(F.collect_list(F.struct(order.alias("o"), "value", "mask", "delta")).alias("cells"))
    row = F.flatten(F.transform(F.array_sort("cells"), lambda c: F.array(c["value"], c["mask"].cast("double"), c["delta"])))
    hours = cells.select("stay_id", F.struct("t", row.alias("x")).alias("hour"))
    return hours.groupBy("stay_id").agg(F.transform(F.array_sort(F.collect_list("hour")), lambda h: h["x"]).alias("tensor"))


def grid_faults(grid: DataFrame, bins: int = 24) -> DataFrame:
    """Numbers of rows that break the grid's rules; all zero for a sound grid."""
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True))).alias
    hours = F.count("*") - F.count_distinct("stay_id") * F.count_distinct("concept") * bins
    return grid.agg(
        bad(F.col("value").isNull() | F.isnan("value"))("bad_value"),
        bad(~F.col("mask").isin(0, 1))("bad_mask"),
        bad((F.col("delta") < 0) | (F.col("delta") > 1))("bad_delta"),
        F.abs(hours).alias("bad_bins"),
    )


def feature_slices(spark, series: dict[str, list[str]], static: list[str]) -> DataFrame:
    """(modality, unit, first, last): the columns of each concept in a packed grid, or of each static feature."""
    rows = [(m, c, 3 * i, 3 * i + 2) for m, concepts in series.items() for i, c in enumerate(concepts)]
    rows += [("static", c, i, i) for i, c in enumerate(static)]
    return spark.createDataFrame(rows, "modality string, unit string, first long, last long")
