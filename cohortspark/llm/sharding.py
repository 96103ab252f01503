"""Sharding by a Feistel permutation of global row numbers.

Method. Rows get gapless numbers 0..N-1 in the order of the given keys. A Feistel network on pairs (left, right) with
left < a, right < b, a = ceil(sqrt N), b = ceil(N / a) permutes 0..ab-1; numbers that land at N or above walk on
along their cycle until they land below N. The permuted number p goes to shard p mod k at slot p div k, so shard sizes
differ by one at most and slots have no gaps. Both directions are plain expressions of N, k and the seed: the shard and
slot of a row number, and the row number at a shard and slot, need no table.

Cases. A null key sorts first; rows equal in every key column are numbered by their place in the input, which changes
nothing as they are equal in what the order sees. Extra columns pass through. An empty table gives an empty result.

Scale. One range shuffle of the rows (its bounds follow the data, ties are broken by the row's place, so a hot key
spreads); a written table pins the numbering. Offsets are one row per partition. The walk's length is found on the
at most ceil(sqrt N) numbers from N to ab-1, since a walk passes through no others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.llm.shared import fresh, staged

SEED = 11
ROUNDS = 4
SHARDS = 8


def numbered(df: DataFrame, keys: list[str], name: str = "row_number") -> DataFrame:
    """``df`` with gapless global numbers from 0, in the order of ``keys``."""
    place, part = fresh(df, "place_in_input"), fresh(df, "place_in_order")
    ordered = df.withColumn(place, F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*keys, place).sortWithinPartitions(*keys, place)
    rows = staged(ordered.drop(place).withColumn(part, F.monotonically_increasing_id()))
    number = F.shiftright(part, 33)
    counts = rows.groupBy(number.alias("part")).agg(F.count("*").alias("n"))  # one row per partition
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("part").alias(f"{part}_of"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(f"{part}_offset"))
    joined = rows.join(F.broadcast(offsets), number == F.col(f"{part}_of"))
    value = F.col(f"{part}_offset") + F.col(part).bitwiseAND(F.lit(2**33 - 1))
    return joined.withColumn(name, value).drop(part, f"{part}_of", f"{part}_offset")


def _mixed(seed: int, turn: Column, half: Column, below: int) -> Column:
    """A number below ``below`` from the seed, the round and one half."""
    text = F.concat_ws(":", F.lit(seed), turn, half)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % below


def _div(x: Column, by: int) -> Column:
    """Whole quotient of a non-negative number, exact: the remainder is taken off first."""
    return ((x - x % by).cast("decimal(20,0)") / F.lit(by)).cast("long")


class Permutation:
    """A permutation of 0..n-1 as Spark expressions."""

    def __init__(self, spark: SparkSession, n: int, seed: int = SEED, rounds: int = ROUNDS) -> None:
        self.n, self.seed, self.rounds = n, seed, rounds
        self.a = max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        self.steps = self._longest_walk(spark)

    def _step(self, x: Column, back: bool = False) -> Column:
        turns = F.sequence(F.lit(1), F.lit(self.rounds))
        if back:
            turns = F.reverse(turns)
        sign = -1 if back else 1

        def turn(s: Column, i: Column) -> Column:
            left = F.pmod(s["l"] + sign * _mixed(self.seed, i, s["r"], self.a), F.lit(self.a).cast("long"))
            right = F.pmod(s["r"] + sign * _mixed(self.seed, i, s["l"], self.b), F.lit(self.b).cast("long"))
            odd = F.struct(left.alias("l"), s["r"].alias("r"))
            even = F.struct(s["l"].alias("l"), right.alias("r"))
            return F.when(i % 2 == 1, odd).otherwise(even)

        x = x.cast("long")
        first = F.struct(_div(x, self.b).alias("l"), (x % self.b).cast("long").alias("r"))
        return F.aggregate(turns, first, turn, lambda s: s["l"] * self.b + s["r"])

    def _longest_walk(self, spark: SparkSession) -> int:
        """How many further steps a number that landed at n or above may need.

        Each step, every path through the numbers from n on loses one of them to below n, until only cycles that no
        number below n enters are left: then the count stays.
        """
        at, steps, left = spark.range(self.n, self.a * self.b), 0, self.a * self.b - self.n
        while left:
            at = staged(at.select(self._step(F.col("id")).alias("id")).where(F.col("id") >= self.n))
            before, left = left, at.count()
            if left == before:
                break
            steps += 1
        return steps + bool(left)

    def _walk(self, x: Column, back: bool) -> Column:
        once = self._step(x, back)
        if not self.steps:
            return once
        again = F.sequence(F.lit(1), F.lit(self.steps))
        return F.aggregate(again, once, lambda y, _: F.when(y >= self.n, self._step(y, back)).otherwise(y))

    def position(self, row: Column) -> Column:
        """Where row number ``row`` lands."""
        return self._walk(row, False)

    def row_at(self, position: Column) -> Column:
        """The row number that lands at ``position``."""
        return self._walk(position, True)


def sharded(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with row_number, shard (int) and slot (long); such columns are replaced."""
    made = ("row_number", "shard", "slot")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in made])
    rows = staged(numbered(df, keys))
    permutation = Permutation(df.sparkSession, rows.count(), seed)
    at = fresh(rows, "position")
    placed = rows.select("*", F.explode(F.array(permutation.position(F.col("row_number")))).alias(at))
    shard, slot = (F.col(at) % shards).cast("int"), _div(F.col(at), shards)
    return placed.withColumns({"shard": shard, "slot": slot}).drop(at)


def row_number_at(permutation: Permutation, shard: Column, slot: Column, shards: int = SHARDS) -> Column:
    """The row number that stands at a shard's slot."""
    return permutation.row_at(slot * shards + shard)


def write_shards(df: DataFrame, keys: list[str], path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write each shard to its own folder, its files in order of slot."""
    rows = sharded(df, keys, shards, seed)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
