"""Joins and windows over time, for entities keyed by ``stay_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.operators.ordering import running_within

HOUR, DAY = 3600.0, 86400.0


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str) -> DataFrame:
    """``left`` with the nearest right time at or after (next_time) and at or before (previous_time) its own.

    Equal times match in both directions; a missing time has no neighbours. Both sides are dealt by ranges of key and
    time, and a range takes over the last right time of earlier ranges and the next one of later ranges, so that one key
    of all rows is spread over all tasks.
    """
    row = F.struct(*[F.col(c) for c in left.columns])
    time = left.schema[left_time].dataType
    a = left.select(F.col(key).alias("key"), F.col(left_time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(time).alias("r"), row.alias("row"))
    times = right.where(F.col(right_time).isNotNull()).select(F.col(key).alias("key"), F.col(right_time).cast(time).alias("t")).distinct()
    b = times.select("key", "t", F.lit(0).alias("side"), F.col("t").alias("r"), F.lit(None).cast(a.schema["row"].dataType).alias("row"))
    # At equal times the right side comes first: it is the previous one, and then also the next.
    run = running_within(a.unionByName(b), ["key"], [F.col("t"), F.col("side")], {}, {"before": "r"}, {"after": "r"})
    after = F.when(F.col("before") == F.col("t"), F.col("t")).when(F.col("t").isNotNull(), F.col("after"))
    return run.where("side = 1").select("row.*", after.alias("next_time"), F.col("before").alias("previous_time"))


def point_window(points: DataFrame, cohort: DataFrame, time: str = "charttime") -> DataFrame:
    """Events of each stay inside its closed window [lower_bound, t0], with hours_before."""
    joined = points.join(cohort.select("stay_id", "lower_bound", "t0"), "stay_id")
    joined = joined.where(F.col(time).between(F.col("lower_bound"), F.col("t0")))
    return joined.withColumn("hours_before", (F.col("t0") - F.col(time)) / HOUR)


def interval_window(intervals: DataFrame, cohort: DataFrame) -> DataFrame:
    """Intervals that touch a stay's closed window, clipped to it; a missing end is the start.

    Adds observed_start, observed_end, observed_s, original_s and hours_before (of the observed end); intervals that
    end before they start are left out.
    """
    ends = intervals.withColumn("endtime", F.coalesce("endtime", "starttime")).where("endtime >= starttime")
    joined = ends.join(cohort.select("stay_id", "lower_bound", "t0"), "stay_id")
    joined = joined.where((F.col("starttime") <= F.col("t0")) & (F.col("endtime") >= F.col("lower_bound")))
    joined = joined.withColumns(
        {"observed_start": F.greatest("starttime", "lower_bound"), "observed_end": F.least("endtime", "t0")}
    )
    return joined.withColumns(
        {
            "observed_s": F.col("observed_end") - F.col("observed_start"),
            "original_s": F.col("endtime") - F.col("starttime"),
            "hours_before": (F.col("t0") - F.col("observed_end")) / HOUR,
        }
    )


def attribute_events(events: DataFrame, stays: DataFrame, margin: float = 2 * DAY) -> DataFrame:
    """``events`` (event_id, parent, time) with the stay of the same parent that they belong to.

    The first stay (by intime, then id) whose time with a margin holds the event; else the only stay of the parent;
    an event without time gets none.
    """
    held = F.col("time").between(F.col("s.intime") - margin, F.col("s.outtime") + margin)
    joined = events.alias("e").join(stays.select("parent", "stay_id", "intime", "outtime").alias("s"), "parent", "left")
    grouped = joined.groupBy("e.event_id").agg(
        F.min_by("s.stay_id", F.when(held, F.struct("s.intime", "s.stay_id"))).alias("inside"),
        F.count("s.stay_id").alias("n"),
        F.min("s.stay_id").alias("only"),
        F.first("e.time").alias("time"),
        F.first("parent").alias("parent"),
    )
    stay = F.when(F.col("time").isNotNull(), F.coalesce("inside", F.when(F.col("n") == 1, F.col("only"))))
    return grouped.select("event_id", "parent", "time", stay.alias("stay_id"))


def tolerance_join(left: DataFrame, right: DataFrame, key: Column, time: Column, low: Column, high: Column) -> DataFrame:
    """Rows of equal key whose time lies within the other side's closed bounds."""
    return left.join(right, key & time.between(low, high))


def hour_grid(bounds: DataFrame) -> DataFrame:
    """Grid points k = 0..n-1 of each stay, an hour apart from grid_start, up to grid_end (n = ceil((end + 1 - start) / 3600))."""
    n = F.ceil((F.col("grid_end") + 1 - F.col("grid_start")) / HOUR).cast("int")
    points = bounds.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return points.withColumn("grid_time", F.col("grid_start") + F.col("k") * HOUR)


def trailing(events: DataFrame, grid: DataFrame, hours: int = 24) -> DataFrame:
    """Minimum, maximum, sum and count of each stay's values in the trailing window (g - hours, g] of each grid time.

    events: stay_id, charttime, value. Values are summed per stay and hour first; each hour then meets the grid in one
    integer range frame, so that events and grid points never multiply.
    """
    starts = grid.select("stay_id", "grid_start").distinct()
    k = F.ceil((F.col("charttime") - F.col("grid_start")) / HOUR).cast("int")
    hourly = events.join(starts.hint("merge"), "stay_id").groupBy("stay_id", k.alias("k")).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("s"), F.count("value").alias("n")
    )
    marks = grid.select("stay_id", "k", F.lit(True).alias("on_grid"))
    both = hourly.unionByName(marks, allowMissingColumns=True)
    frame = Window.partitionBy("stay_id").orderBy("k").rangeBetween(-(hours - 1), 0)
    rolled = both.select(
        "stay_id",
        "k",
        "on_grid",
        F.min("lo").over(frame).alias("window_min"),
        F.max("hi").over(frame).alias("window_max"),
        F.coalesce(F.sum("s").over(frame), F.lit(0.0)).alias("window_sum"),
        F.coalesce(F.sum("n").over(frame), F.lit(0)).alias("window_count"),
    )
    return rolled.where("on_grid").drop("on_grid")


def trailing_worst(events: DataFrame, grid: DataFrame, worst: dict[str, tuple[Column, str]], hours: int = 24) -> DataFrame:
    """``grid`` with several components over the trailing window of each grid time, in one pass.

    events: stay_id, charttime and what the components' values need. worst: new column -> (value, min, max, sum or count);
    a sum or count of nothing is 0. Events that no window of their stay holds are left out before anything is summed.
    """
    bounds = grid.groupBy("stay_id").agg(F.first("grid_start").alias("start"), F.max("k").alias("last"))
    k = F.ceil((F.col("charttime") - F.col("start")) / HOUR).cast("int")
    hour = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}
    window = hour | {"count": F.sum}
    near = events.join(bounds.hint("merge"), "stay_id").withColumn("k", k).where(F.col("k").between(1 - hours, F.col("last")))
    hourly = near.groupBy("stay_id", "k").agg(*[hour[how](value).alias(name) for name, (value, how) in worst.items()])
    both = hourly.unionByName(grid.select("stay_id", "k", F.struct(*grid.columns).alias("row")), allowMissingColumns=True)
    frame = Window.partitionBy("stay_id").orderBy("k").rangeBetween(-(hours - 1), 0)
    rolled = {name: window[how](name).over(frame) for name, (_, how) in worst.items()}
    rolled |= {name: F.coalesce(rolled[name], F.lit(0)) for name, (_, how) in worst.items() if how in ("sum", "count")}
    filled = both.select("row", *[c.alias(name) for name, c in rolled.items()])
    return filled.where("row is not null").select("row.*", *worst)


def trailing_interval_max(intervals: DataFrame, grid: DataFrame, hours: int = 24) -> DataFrame:
    """Largest rate of the intervals active in the closed trailing window [g - hours, g] of each grid time."""
    sizes = grid.groupBy("stay_id").agg(F.first("grid_start").alias("grid_start"), F.max("k").alias("last"))
    joined = intervals.join(sizes.hint("merge"), "stay_id")
    first = F.greatest(F.ceil((F.col("starttime") - F.col("grid_start")) / HOUR).cast("int"), F.lit(0))
    end = F.least(F.floor((F.col("endtime") - F.col("grid_start")) / HOUR).cast("int") + hours, F.col("last"))
    active = joined.where(first <= end).select("stay_id", F.explode(F.sequence(first, end)).alias("k"), "rate")
    most = active.groupBy("stay_id", "k").agg(F.max("rate").alias("window_rate"))
    return grid.select("stay_id", "k").join(most.hint("merge"), ["stay_id", "k"], "left")


def first_hit(scored: DataFrame, total: str, threshold: int, parts: list[str]) -> DataFrame:
    """The first grid hour of each stay whose total reaches the threshold, with its parts."""
    hits = scored.where(F.col(total) >= threshold)
    best = hits.groupBy("stay_id").agg(F.min_by(F.struct("k", "grid_time", total, *parts), "k").alias("h"))
    return best.select("stay_id", "h.*")


def readmission(rows: DataFrame, key: str, start: str, end: str, order: list[str], days: int = 30) -> DataFrame:
    """``rows`` with the time since the key's previous end and whether it is within 0 to ``days`` days."""
    previous = F.lag(end).over(Window.partitionBy(key).orderBy(*order))
    gap = F.col(start) - previous
    within = F.when(gap.isNotNull() & (gap >= 0) & (gap <= days * DAY), 1).otherwise(0)
    return rows.withColumns({"gap_s": gap, "readmitted": within})


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("rank_in_key", rank).where("rank_in_key = 1").drop("rank_in_key")
