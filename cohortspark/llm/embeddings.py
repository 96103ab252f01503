"""Embedding near-duplicates by int8 tile products with error bounds.

Method. Each vector is scaled to unit length x and coded as x' = s * c with int8 codes c and its own scale s. For two
vectors the cosine differs from x'.y' by at most e(x)|y'| + e(y)|x'| + e(x)e(y), where e(x) = |x - x'| is the vector's
own error. Vectors of one label are cut into tiles of codes; a pair of tiles multiplies its codes as matrix products
(whole numbers, exact in 32-bit floats over up to 1024 dimensions at a time and summed in double precision) and splits
the pairs: certainly linked, certainly not, or within the bounds. Only the last are computed again, from the full
vectors in double precision.

Equal vectors of a label count as one member with a multiplicity, so a group of copies is one member. A pair of tiles
returns, for each member, the number of links, and a forest of its links rather than all of them.

Cases. A null vector, a zero vector, one with null or non-finite components, or one of another length than most
links with nothing; so does any vector with a null label. Vectors of unequal length never link. Repeated rows are
vectors of their own. A null vec_id is a vector too; its component is the least vec_id it reaches. An empty table
gives an empty result. Extra columns are not read, whatever their names.

Scale. All pairs of a label are compared, as the task asks; a task holds the codes of two tiles, whatever the label's
size, and works through them in blocks of rows. What travels to a pair of tiles is codes and four numbers a vector;
full vectors are joined to the pairs within the bounds only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.components import connected_components, least_reachable
from cohortspark.llm.shared import sent, staged

THRESHOLD = 0.93
#: Vectors in a tile, and rows of a block within it.
TILE, BLOCK = 4096, 256
#: Dimensions over which sums of products of codes are exact in 32-bit floats: 127 * 127 * 1024 < 2**24.
EXACT_DIMENSIONS = 1024
#: What rounding in double precision may add to a bound (up to a million dimensions).
_SLACK = 1e-9


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scales, lengths of the coded vectors and error bounds of unit vectors (rows)."""
    scales = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scales[:, None]).astype(np.int8)
    coded = codes * scales[:, None]
    return codes, scales, np.linalg.norm(coded, axis=1), np.linalg.norm(vectors - coded, axis=1)


class Tile:
    """Codes of vectors of one length, and what the bounds need."""

    def __init__(self, codes: bytes, numbers: bytes, dim: int) -> None:
        self.codes = np.frombuffer(codes, np.int8).reshape(-1, dim).astype(np.float32)
        self.scales, self.norms, self.errors = np.frombuffer(numbers).reshape(3, -1)


def products(x: Tile, y: Tile, rows: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For some rows of ``x`` and all of ``y``: certainly linked, and within the bounds."""
    near = np.zeros((len(x.codes[rows]), len(y.codes)))
    for at in range(0, x.codes.shape[1], EXACT_DIMENSIONS):
        some = slice(at, at + EXACT_DIMENSIONS)
        near += x.codes[rows, some] @ y.codes[:, some].T
    near *= np.outer(x.scales[rows], y.scales)
    bound = np.outer(x.errors[rows], y.norms + y.errors) + np.outer(x.norms[rows], y.errors) + _SLACK
    linked = near - bound >= threshold
    return linked, (near + bound >= threshold) & ~linked


def compared(ids: np.ndarray, copies: np.ndarray, x: Tile, other: tuple | None, threshold: float) -> pd.DataFrame:
    """Rows of a pair of tiles (or of one with itself): (a, null, links), (a, b, 0) of a forest, (a, b, -1) to look at."""
    ids_2, copies_2, y = other or (ids, copies, x)
    nodes = ids if other is None else np.concatenate([ids, ids_2])
    shift = 0 if other is None else len(ids)
    label, open_ = np.arange(len(nodes)), []
    links, links_2 = np.zeros(len(ids)), np.zeros(len(ids_2))
    for at in range(0, len(ids), BLOCK):
        rows = slice(at, at + BLOCK)
        linked, unsure = products(x, y, rows, threshold)
        if other is None:  # each pair once, none with itself
            later = np.arange(len(ids_2))[None, :] > np.arange(len(ids))[rows, None]
            linked, unsure = linked & later, unsure & later
        links[rows] += linked.astype(float) @ copies_2
        links_2 += copies[rows] @ linked.astype(float)
        a, b = np.nonzero(linked)
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        label = least_reachable(np.append(a + at, moved), np.append(b + shift, label[moved]), len(nodes))
        a, b = np.nonzero(unsure)
        open_.append((ids[a + at], ids_2[b]))
    count = np.append(links, links_2) if other is not None else links + links_2
    some, moved = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(nodes)))
    parts = [(nodes[some], np.full(len(some), -1), count[some]), (nodes[moved], nodes[label[moved]], np.zeros(len(moved)))]
    parts += [(a, b, np.full(len(a), -1)) for a, b in open_]
    a, b, n = (np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))
    return pd.DataFrame({"a": a, "b": b, "n": n})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept.

    vectors: vec_id, embedding (array of numbers), label.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    fit = F.col("label").isNotNull() & F.coalesce(finite & (norm > 0) & (norm < F.lit(1e300)), F.lit(False))
    # Text of the numbers: equal vectors of a label are one member, whatever their group's size.
    rows = rows.withColumn("fit", fit).withColumn("key", F.when(F.col("fit"), F.unhex(F.sha2(F.to_json(F.struct("x")), 256))))
    members = rows.where("fit").groupBy("label", "key").agg(
        F.first("x").alias("x"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id")
    )
    # Numbered as it is written: from here on a member is its number.
    members = staged(members.withColumn("node", F.monotonically_increasing_id()))
    counts = members.groupBy("label", F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    counts = staged(counts.select("label", "dim", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    placed = members.withColumn("dim", F.size("x")).join(sent(counts), ["label", "dim"])
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    label_type = dict(members.dtypes)["label"]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        first, full = group.iloc[0], np.stack(group.x.to_list()).astype(np.float64)
        codes, *numbers = quantised(full / np.linalg.norm(full, axis=1)[:, None])
        return pd.DataFrame(
            {
                "label": [first.label],
                "dim": [first.dim],
                "tiles": [first.tiles],
                "tile": [first.tile],
                "ids": [group.node.to_numpy(np.int64).tobytes()],
                "copies": [group.copies.to_numpy(np.int64).tobytes()],
                "codes": [codes.tobytes()],
                "numbers": [np.stack(numbers).tobytes()],
            }
        )

    schema = f"label {label_type}, dim int, tiles int, tile int, ids binary, copies binary, codes binary, numbers binary"
    packed = placed.select("label", "dim", "tiles", "tile", "node", "copies", "x")
    packed = staged(packed.groupBy("label", "dim", "tile").applyInPandas(pack, schema))
    pairs = packed.select("*", F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("other"))
    right = packed.select("label", "dim", F.col("tile").alias("other"), *[F.col(c).alias(f"{c}_2") for c in ("ids", "copies", "codes", "numbers")])
    both = pairs.join(right.hint("merge"), ["label", "dim", "other"])
    # A row is a pair of tiles, dealt one by one and not by label; a task gets a few, as they reach Python in one batch.
    pairs_of = F.col("tiles").cast("long") * (F.col("tiles") + 1) / 2
    total = counts.agg(F.coalesce(F.sum(pairs_of), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(max(least, int(total) // 4), F.xxhash64("label", "dim", "tile", "other"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, copies = (np.frombuffer(v, np.int64) for v in (r.ids, r.copies))
                other = None
                if r.tile != r.other:
                    ids_2, copies_2 = (np.frombuffer(v, np.int64) for v in (r.ids_2, r.copies_2))
                    other = ids_2, copies_2.astype(float), Tile(r.codes_2, r.numbers_2, r.dim)
                yield compared(ids, copies.astype(float), Tile(r.codes, r.numbers, r.dim), other, threshold)

    found = staged(both.mapInPandas(compare, "a long, b long, n long"))
    sure = found.where("n >= 0")
    links = sure.where("b < 0").select(F.col("a").alias("node"), "n")
    edges = sure.where("b >= 0").select("a", "b")
    unsure = found.where("n < 0").select("a", "b")
    if unsure.limit(1).count():
        linked = staged(exact_links(unsure, members, threshold))
        edges = edges.unionByName(linked.select("a", "b"))
        links = links.union(linked.select("a", "copies_b")).union(linked.select("b", "copies_a"))
    links = staged(links.groupBy("node").agg(F.sum("n").alias("n")))
    groups = connected_components(edges)
    named = members.select("node", "label", "key", "copies", "least_id")
    roots = groups.join(named.select("node", "least_id").hint("merge"), "node")
    least_ids = staged(roots.groupBy("root").agg(F.min("least_id").alias("joined_id")))
    roots = staged(groups.join(least_ids.hint("merge"), "root").select("node", "joined_id"))
    info = named.join(links.hint("merge"), "node", "left").join(roots.hint("merge"), "node", "left")
    info = staged(
        info.select(
            "label",
            "key",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("joined_id", "least_id").alias("component_id"),
        )
    )
    # Vectors that link with nothing stay out of the join.
    alone = rows.where(~F.col("fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rest = rows.where("fit").select("vec_id", "label", "key").join(info.hint("merge"), ["label", "key"])
    out = alone.unionByName(rest.select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def exact_links(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of members whose cosine in double precision reaches the threshold, with the copies of both."""
    for side in "ab":
        full = members.select(F.col("node").alias(side), F.col("x").alias(f"x_{side}"), F.col("copies").alias(f"copies_{side}"))
        pairs = pairs.join(full.hint("merge"), side)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("x_a", "x_b") / (F.sqrt(dot("x_a", "x_a")) * F.sqrt(dot("x_b", "x_b")))
    return pairs.where(cosine >= threshold).select("a", "b", "copies_a", "copies_b")
