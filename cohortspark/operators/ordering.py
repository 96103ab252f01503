"""Running sums, minima and ranks over one global order, without a single-task window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.sources.staging import pinned

#: Up to so many groups, one row of each is sent to every task.
GROUPS = 100_000


def global_running(df: DataFrame, order: list[Column], sums: dict[str, str], mins: dict[str, str] | None = None) -> DataFrame:
    """``df`` with running values over the whole order, which must be total.

    sums: new column -> column summed up to and with the row. mins: new column -> column whose minimum is taken up to
    and with the row, and ``<new>_before`` up to but without it. Rows are dealt by ranges of the order; each range runs
    by itself and starts from the totals of the ranges before it, one row each.
    """
    mins = mins or {}
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = pinned(placed.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_part").agg(
        *[F.sum(c).alias(f"_total_{n}") for n, c in sums.items()], *[F.min(c).alias(f"_total_{n}") for n, c in mins.items()]
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_part",
        *[F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in sums],
        *[F.min(f"_total_{n}").over(before).alias(f"_start_{n}") for n in mins],
    )
    joined = placed.join(F.broadcast(parts), "_part")
    rows = Window.partitionBy("_part").orderBy("_at")
    upto, earlier = rows.rowsBetween(Window.unboundedPreceding, 0), rows.rowsBetween(Window.unboundedPreceding, -1)
    columns = {n: F.col(f"_start_{n}") + F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()}
    for n, c in mins.items():
        columns[n] = F.least(F.col(f"_start_{n}"), F.min(c).over(upto))
        columns[f"{n}_before"] = F.least(F.col(f"_start_{n}"), F.min(c).over(earlier))
    out = joined.withColumns(columns)
    return out.drop("_at", "_part", *[f"_start_{n}" for n in (*sums, *mins)])


def running_within(
    df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str], maxes: dict[str, str] | None = None, mins_after: dict[str, str] | None = None
) -> DataFrame:
    """``df`` with running sums (new column -> column) within each group of ``keys``, whatever the groups' sizes.

    maxes: new column -> column whose largest value up to and with the row is taken. mins_after: new column -> column
    whose least value from the row to the group's end is taken; both are null where there is none.

    The order must be total within a group. Rows are dealt by ranges of keys and order, so that a large group lies in
    many ranges and a range holds many small groups. A range runs by itself; what its first group has in earlier ranges
    is the sum of its totals there, and its last group likewise takes over from later ranges. Two rows a range travel for
    this. Null keys are a group.
    """
    maxes, mins_after = maxes or {}, mins_after or {}
    placed = df.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*keys, *order)
    placed = pinned(placed.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    group = F.struct(*keys)
    ends = placed.groupBy("_part").agg(F.min_by(group, "_at").alias("_first"), F.max_by(group, "_at").alias("_last"))
    totals = [F.sum(c).alias(f"_total_{n}") for n, c in sums.items()]
    totals += [F.max(c).alias(f"_total_{n}") for n, c in maxes.items()] + [F.min(c).alias(f"_total_{n}") for n, c in mins_after.items()]
    grouped = placed.groupBy("_part", group.alias("_group")).agg(*totals)
    edges = ends.join(grouped.hint("merge"), "_part").where(F.col("_first").eqNullSafe(F.col("_group")) | F.col("_last").eqNullSafe(F.col("_group")))
    # Of each range its first and its last group, one row where they are one; a group has a row for each range that it reaches into.
    edges = pinned(edges.select("_part", "_group", *[f"_total_{n}" for n in (*sums, *maxes, *mins_after)]))
    reach = Window.partitionBy("_group").orderBy("_part")
    before, after = reach.rowsBetween(Window.unboundedPreceding, -1), reach.rowsBetween(1, Window.unboundedFollowing)
    starts = edges.select(
        F.col("_part").alias("_of"),
        "_group",
        *[F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in sums],
        *[F.max(f"_total_{n}").over(before).alias(f"_start_{n}") for n in maxes],
        *[F.min(f"_total_{n}").over(after).alias(f"_start_{n}") for n in mins_after],
    )
    rows = Window.partitionBy("_part", *keys).orderBy("_at")
    upto, onwards = rows.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("_part", *keys).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumns(
        {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()}
        | {n: F.max(c).over(upto) for n, c in maxes.items()}
        | {n: F.min(c).over(onwards) for n, c in mins_after.items()}
    )
    joined = run.join(F.broadcast(starts), (run["_part"] == starts["_of"]) & group.eqNullSafe(starts["_group"]), "left")
    joined = joined.withColumns(
        {n: F.col(n) + F.coalesce(f"_start_{n}", F.lit(0)) for n in sums}
        | {n: F.greatest(n, f"_start_{n}") for n in maxes}
        | {n: F.least(n, f"_start_{n}") for n in mins_after}
    )
    return joined.drop("_at", "_part", "_of", "_group", *[f"_start_{n}" for n in (*sums, *maxes, *mins_after)])


def group_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linear quantiles (new column -> share) of a value in each group, and the count n of its values.

    Equal values are summed first; ranks are running counts, so that no task holds a group. Of each group only the
    values at the wanted ranks are gathered. Nulls are left out; a group of nulls only has null quantiles and n = 0.
    """
    cells = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_rows"))
    cells = cells.withColumn("_n", F.when(F.col("_v").isNotNull(), F.col("_rows")).otherwise(0))
    order = [F.col("_v").asc_nulls_first()]
    run = pinned(running_within(cells, keys, order, {"_upto": "_n"}) if keys else global_running(cells, order, {"_upto": "_n"}))
    sizes = run.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    sizes = pinned(sizes)
    named = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_size")
    # One row a group: a broadcast where the groups are few.
    named = F.broadcast(named) if not keys or named.limit(GROUPS + 1).count() <= GROUPS else named.hint("merge")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = run.join(named, reduce(lambda a, b: a & b, same)) if keys else run.crossJoin(named)
    first, columns = F.col("_upto") - F.col("_n"), []
    for name, share in shares.items():
        spot = F.lit(float(share)) * (F.col("_size") - 1)
        low = F.floor(spot)
        at = lambda place: F.max(F.when((F.col("_n") > 0) & (first <= place) & (place < F.col("_upto")), F.col("_v")))
        columns += [at(low).alias(f"_low_{name}"), at(F.least(low + 1, F.col("_size") - 1)).alias(f"_high_{name}"), F.max(spot - low).alias(f"_off_{name}")]
    found = rows.groupBy(*keys).agg(F.max("_size").alias("n"), *columns)
    value_of = lambda n: F.col(f"_low_{n}") + F.col(f"_off_{n}") * (F.col(f"_high_{n}") - F.col(f"_low_{n}"))
    return found.select(*keys, "n", *[value_of(n).alias(n) for n in shares])
