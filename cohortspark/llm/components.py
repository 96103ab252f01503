"""Connected components of a graph that is only known as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.shared import drop_folder, shared_folder, staged


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """For each u the least of u and its neighbours; the partial aggregate keeps a hub's rows apart."""
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u"), F.least("u", "v").alias("m"))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Rows (node, root) for every node of an edge, root being the least node of its component.

    edges: two columns of one orderable type; direction, repeats and loops do not matter, edges with a null end are
    left out. An empty table gives an empty table.

    Method: alternating large-star and small-star steps. Each replaces edges to a node's neighbours by edges to the
    least of them, never adding edges, until nothing changes (a number of rounds that grows with the logarithm of
    the longest path). Both sides of each join are written tables, so a hub's rows can be split at run time. Each
    round is written to the shared folder, and the one before it removed.
    """
    spark = edges.sparkSession
    a, b = F.col(left), F.col(right)
    pairs = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    pairs = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path = shared_folder(spark)
    current = staged(pairs, path)
    before = _signature(current)
    while before[0]:
        olds = [path]
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        olds.append(shared_folder(spark))
        least = staged(_least_neighbour(both), olds[-1])
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        olds.append(shared_folder(spark))
        large = staged(large.distinct(), olds[-1])
        olds.append(shared_folder(spark))
        least = staged(_least_neighbour(large), olds[-1])
        joined = large.join(least.hint("merge"), "u")
        small = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v")
        path = shared_folder(spark)
        current = staged(small.distinct(), path)
        for old in olds:
            drop_folder(spark, old)
        now = _signature(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least one that it reaches over the edges (a, b), within one task."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new
