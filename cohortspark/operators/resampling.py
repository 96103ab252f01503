"""Bootstrap replicates as vectors of counts, drawn by a tree of binomials over the ordered score groups.

Method. Rows of equal scores and label are one group; groups lie in one order. A replicate draws as many rows as there
are, with replacement: all its draws start at the whole order and are split, again and again, over the two halves of a
range by a binomial draw with the halves' weights, down to single groups. That is the multinomial draw of plain
resampling, so models that stand in one row are resampled together. A binomial draw is the inverse of its distribution
at a number in [0, 1) hashed from seed, replicate and the place of the cut: reruns and other engines agree.

Scale. No row is multiplied: a group carries one vector of counts for each chunk of ``CHUNK`` replicates, one byte a count
unless some are above 255. A step of the tree takes each node down ``_DEPTH`` levels at most, nodes and chunks in
parallel, and there are log(groups) / log(256) steps; the last one gives the groups with their vectors, without a join. A
group of a third of all rows is one leaf. Metrics go over ranges of the score order; a range gives a few sums for each
replicate, which add up over ranges. What a task holds is a batch of vectors.

Cases. Null scores are a group of their own, ordered first by the tree and last by a metric (a null is no alarm); rows
with a null label are not drawn. Replicates without both labels have a null AUROC, those without a base a null rate. An
empty table has no groups and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.operators.ordering import global_running
from cohortspark.sources.staging import pinned

CHUNK = 250
_DEPTH = 8
#: Entries of distribution tables that are held at once.
_TABLE = 2_000_000
#: Up to so many draws, a binomial is found by adding terms one by one.
_FEW = 256
#: Counts that are split or summed at once.
_BLOCK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers: shifts and products of the public murmur3 finaliser."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(2246822507)
    x ^= x >> np.uint32(13)
    x *= np.uint32(3266489909)
    x ^= x >> np.uint32(16)
    return x


def uniform(seed: int, replicates: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A number in [0, 1) of 53 bits for each pair of replicate and cut, from two lanes that take in both."""
    a = np.full(len(replicates), seed & 0xFFFFFFFF, np.uint32)
    b = a ^ np.uint32(2654435769)
    for part in (replicates, cuts, cuts >> 32):
        a = mixed(a + part.astype(np.uint32))
        b = mixed(b ^ a)
    return ((b.astype(np.uint64) << np.uint64(21)) + (a >> np.uint32(11))).astype(np.float64) / 2.0**53


def binomial(draws: np.ndarray, shares: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Least k whose distribution at a number of draws and a share in (0, 1) is above u, for each triple of them."""
    out, none = np.zeros_like(draws), draws * np.log1p(-shares)
    few = (draws <= _FEW) & (none > -600)
    many = np.flatnonzero(~few)
    out[many] = _by_table(draws[many], shares[many], u[many])
    at = np.flatnonzero(few)
    m, p, u = draws[at].astype(float), shares[at], u[at]
    term, k = np.exp(none[at]), 0
    upto, odds = term.copy(), p / (1 - p)
    while True:
        above = np.flatnonzero((upto <= u) & (k < m))
        if len(above) == 0:
            return out
        at, m, u, term, upto, odds = (x[above] for x in (at, m, u, term, upto, odds))
        term *= (m - k) / (k + 1) * odds
        upto += term
        k += 1
        out[at] = k


def _by_table(draws: np.ndarray, shares: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The same for many draws.

    Terms come from their ratios, over nine deviations to both sides of the mean; what lies beyond weighs less than the
    last bit of u. Equal pairs of draws and share have one row of terms.
    """
    out = np.zeros_like(draws)
    reach = 9 * np.sqrt(draws * shares * (1 - shares)) + 40
    widths = np.minimum(2 * reach + 2, draws + 1).astype(np.int64)
    order, at = np.argsort(widths, kind="stable"), 0
    while at < len(order):
        # So many triples that the widest of them all fit the table; one at least.
        held = order[at : at + max(1, _TABLE // int(widths[order[-1]]))]
        at += len(held)
        pairs, of = np.unique(draws[held] + 1j * shares[held], return_inverse=True)
        m, p = pairs.real[:, None], pairs.imag[:, None]
        k0 = np.maximum(0, np.floor(m * p - (9 * np.sqrt(m * p * (1 - p)) + 40)))
        k = k0 + np.arange(int(widths[held].max()) - 1)[None, :]
        with np.errstate(divide="ignore"):
            ratio = np.log(np.maximum(m - k, 0)) - np.log(k + 1.0) + (np.log(p) - np.log1p(-p))
        logs = np.concatenate([np.zeros((len(m), 1)), np.cumsum(ratio, axis=1)], axis=1)
        upto = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
        upto /= upto[:, -1:]
        of = of.ravel()
        found = k0[of, 0].astype(np.int64) + (upto[of] <= u[held, None]).sum(axis=1)
        out[held] = np.minimum(found, draws[held])
    return out


def split_nodes(counts: np.ndarray, weights: np.ndarray, bounds: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Counts of the parts of nodes (nodes x parts x replicates), whose number is a power of two.

    counts and replicates: nodes x replicates. weights: nodes x parts. bounds: the places where the parts begin, and the end.
    """
    n, parts = weights.shape
    before = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(weights, axis=1)], axis=1)
    nodes = counts[:, None, :]
    while nodes.shape[1] < parts:
        span = parts // nodes.shape[1]
        first = np.arange(nodes.shape[1]) * span
        left, whole = before[:, first + span // 2] - before[:, first], before[:, first + span] - before[:, first]
        lefts = np.where((left == whole)[:, :, None], nodes, 0)
        of, node, drawn = np.nonzero(((left > 0) & (left < whole))[:, :, None] & (nodes > 0))
        if len(of):
            u = uniform(seed, replicates[of, drawn], bounds[of, first[node] + span // 2])
            lefts[of, node, drawn] = binomial(nodes[of, node, drawn], (left / np.maximum(whole, 1))[of, node], u)
        nodes = np.stack([lefts, nodes - lefts], axis=2).reshape(n, 2 * len(first), -1)
    return nodes


def packed(counts: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Numbers of rows, and those rows of counts as bytes: the width of a count, then little-endian counts of that width."""
    most = counts.max(axis=1, initial=0)
    width = 1 << ((most > 0xFF).astype(int) + (most > 0xFFFF) + (most > 0xFFFFFFFF))
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        body = counts[rows].astype(f"<u{w}").view(np.uint8)
        data = np.concatenate([np.full((len(rows), 1), w, np.uint8), body], axis=1)
        ends = (np.arange(len(rows) + 1) * data.shape[1]).astype(np.int32)
        yield rows, pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def unpacked(vectors: pa.Array, wide: bool) -> np.ndarray:
    """Rows x replicates of vectors of one chunk; wide ones are 64-bit counts without a leading width."""
    starts = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1]
    data = np.frombuffer(vectors.buffers()[2], np.uint8)
    sizes = np.diff(starts)
    width = np.full(len(sizes), 8) if wide else data[starts[:-1]]
    out = np.zeros((len(sizes), sizes[0] // 8 if wide else (sizes[0] - 1) // int(width[0])), np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        spots = starts[rows][:, None] + np.arange(0 if wide else 1, sizes[rows[0]])
        out[rows] = data[spots].view("<i8" if wide else f"<u{w}")
    return out


def _node(groups: int, depth: int) -> Column:
    """The node of place g at a depth: node i holds the places from i * groups >> depth up to the next node's."""
    return F.expr(f"cast(((cast(g as decimal(19,0)) + 1) * {1 << depth} - 1) div {groups} as bigint)")


def drawn(rows: DataFrame, columns: list[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """The groups of ``columns`` (scores and y) with their counts: (columns..., weight, chunk, packed), a written table.

    packed: counts of the replicates chunk * CHUNK and on, as ``packed`` makes them.
    """
    spark = rows.sparkSession
    groups = rows.where("y is not null").groupBy(*columns).agg(F.count("*").alias("weight")).withColumn("one", F.lit(1).cast("long"))
    order = [F.col(c).asc_nulls_first() for c in columns]
    groups = pinned(global_running(groups, order, {"g": "one"}).withColumn("g", F.col("g") - 1).drop("one"))
    size, total = groups.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels = max(1, (max(size, 1) - 1).bit_length())
    steps = -(-levels // _DEPTH)
    down = -(-levels // steps)
    starts = [np.full((1, min(CHUNK, replicates - c * CHUNK)), total) for c in range(-(-replicates // CHUNK))]
    starts = [(0, c, bytearray(v.as_py())) for c, start in enumerate(starts) for _, a in packed(start) for v in a]
    nodes = spark.createDataFrame(starts if size else [], "node long, chunk long, packed binary")
    leaves = groups.select(*columns, "weight").schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ")
    for step in range(steps):
        depth, last = down * (step + 1), step == steps - 1
        child = _node(max(size, 1), depth)
        part = F.col("child").bitwiseAND(F.lit((1 << down) - 1)).cast("int").alias("part")
        if last:
            parts = groups.select(child.alias("child"), F.struct(*columns, "weight").alias("leaf"), "weight")
        else:
            parts = groups.groupBy(child.alias("child")).agg(F.sum("weight").alias("weight")).withColumn("leaf", F.lit(None).cast("int"))
        parts = parts.groupBy(F.shiftright("child", down).alias("node")).agg(F.collect_list(F.struct(part, "weight", "leaf")).alias("parts"))  # 256 at most
        # Nodes are few bytes and much work: their partitions must not be put together by size.
        spread = nodes.join(parts.hint("merge"), "node").repartition(tasks, "node", "chunk").select("node", "chunk", "packed", "parts")
        schema = f"{leaves}, chunk long, packed binary" if last else nodes.schema
        nodes = pinned(spread.mapInArrow(_down(down, depth, size, seed, last), schema))
    return nodes


def _down(levels: int, depth: int, size: int, seed: int, last: bool):
    """Splits nodes into parts; in the last step parts are groups, which come out by their columns."""
    fan = 1 << levels

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, chunk = (batch.column(i).to_numpy() for i in (0, 1))
            lists = batch.column(3)
            ends, items = lists.offsets.to_numpy(), lists.values
            part, weight = (items.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            step = max(1, _BLOCK // (fan * CHUNK))
            for same in (np.flatnonzero(chunk == c) for c in np.unique(chunk)):
                for at in range(0, len(same), step):
                    rows = same[at : at + step]
                    counts = unpacked(batch.column(2).take(pa.array(rows)), False)
                    spots = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows])
                    of = np.repeat(np.arange(len(rows)), ends[rows + 1] - ends[rows])
                    weights = np.zeros((len(rows), fan), np.int64)
                    weights[of, part[spots]] = weight[spots]
                    bounds = np.array([[((int(node[r]) * fan + i) * size) >> depth for i in range(fan + 1)] for r in rows])
                    replicates = np.broadcast_to(np.arange(counts.shape[1]) + chunk[rows[0]] * CHUNK, counts.shape)
                    found = split_nodes(counts, weights, bounds, replicates, seed)[of, part[spots]]
                    for held, vectors in packed(found):
                        mine = spots[held]
                        if last:
                            keys = items.field(2).take(pa.array(mine))
                            lead = {keys.type.field(i).name: keys.field(i) for i in range(keys.type.num_fields)}
                        else:
                            lead = {"node": pa.array(node[rows][of[held]] * fan + part[mine])}
                        lead["chunk"] = pa.array(np.full(len(mine), chunk[rows[0]]))
                        yield pa.RecordBatch.from_pydict({**lead, "packed": vectors})

    return split


def resampled(rows: DataFrame, columns: list[str], replicates: int = 1000, seed: int = 0) -> DataFrame:
    """``drawn`` with counts in place of packed: 64-bit little-endian counts, as bytes."""
    table = drawn(rows, columns, replicates, seed)

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = {n: batch.column(i) for i, n in enumerate(batch.schema.names[:-1])}
            counts = [unpacked(batch.column(batch.num_columns - 1).slice(i, 1), False).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_pydict({**lead, "counts": pa.array(counts, pa.binary())})

    schema = table.schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ").replace("packed binary", "counts binary")
    return table.mapInArrow(widened, schema)


def _vectors(counted: DataFrame) -> tuple[str, bool]:
    """The column of vectors of ``drawn`` or ``resampled`` rows, and whether they are wide."""
    return ("packed", False) if "packed" in counted.columns else ("counts", True)


def replicate_rows(counted: DataFrame, models: dict[str, str]) -> DataFrame:
    """(model, replicate, prob, y, times) of the drawn groups, for metrics that are no sums over ranges.

    Here each group is a row in each replicate that draws it.
    """
    vector, wide = _vectors(counted)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(counts=[np.frombuffer(c, "<i8") if wide else np.frombuffer(c, f"<u{c[0]}", offset=1).astype("<i8") for c in batch["counts"]])

    named = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("prob")) for m, c in models.items()])
    rows = counted.select(named.alias("models"), F.col("y").cast("int").alias("y"), "chunk", F.col(vector).alias("counts"))
    rows = rows.mapInPandas(listed, "models array<struct<model string, prob double>>, y int, chunk long, counts array<long>")
    rows = rows.select("models", "y", "chunk", F.posexplode("counts").alias("at", "times")).where("times > 0")
    rows = rows.select(F.explode("models").alias("m"), "y", (F.col("chunk") * CHUNK + F.col("at")).alias("replicate"), "times")
    return rows.select("m.model", "replicate", "m.prob", "y", "times")


_SUMS = "model string, chunk long, part int, pos array<double>, neg array<double>, area array<double>"


def _areas(wide: bool):
    """By model and chunk of one range: draws of both labels, and the area that the range's rows have among themselves."""

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tie = None
        part, pos, neg, area, tie_pos, tie_neg = 0, None, None, None, None, None

        def out():
            """The running sums with the last group of equal scores."""
            sums = {"pos": pos + tie_pos, "neg": neg + tie_neg, "area": area + tie_neg * (pos + tie_pos / 2)}
            return pa.RecordBatch.from_pydict({"model": [key[0]], "chunk": [key[1]], "part": pa.array([part], pa.int32()), **{n: [v] for n, v in sums.items()}})

        for batch in batches:
            if batch.num_rows == 0:
                continue
            model, chunk, at = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(5)[0].as_py()
            prob = batch.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False)
            positive = batch.column(3).to_numpy(zero_copy_only=False) == 1
            turns = np.flatnonzero((model[1:] != model[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            for first, end in zip([0, *turns], [*turns, len(model)], strict=True):
                if (model[first], chunk[first]) != key:
                    if key is not None:
                        yield out()
                    key, tie, part = (model[first], chunk[first]), None, at
                    pos = neg = area = tie_pos = tie_neg = 0.0
                for low in range(first, end, _BLOCK // CHUNK):
                    rows = slice(low, min(low + _BLOCK // CHUNK, end))
                    counts = unpacked(batch.column(4).slice(low, rows.stop - low), wide).astype(float)
                    scores, y = prob[rows], positive[rows, None]
                    other = (scores[1:] != scores[:-1]) & ~(np.isnan(scores[1:]) & np.isnan(scores[:-1]))
                    starts = np.concatenate([[0], np.flatnonzero(other) + 1])
                    p = np.add.reduceat(np.where(y, counts, 0.0), starts, axis=0)
                    n = np.add.reduceat(np.where(y, 0.0, counts), starts, axis=0)
                    if tie is not None and (scores[0] == tie or (np.isnan(scores[0]) and np.isnan(tie))):
                        p[0] += tie_pos
                        n[0] += tie_neg
                    else:
                        area = area + tie_neg * (pos + tie_pos / 2)
                        pos, neg = pos + tie_pos, neg + tie_neg
                    tie, tie_pos, tie_neg = scores[-1], p[-1], n[-1]
                    p, n = p[:-1], n[:-1]
                    above = pos + np.cumsum(p, axis=0) - p
                    area = area + (n * (above + p / 2)).sum(axis=0)
                    pos, neg = pos + p.sum(axis=0), neg + n.sum(axis=0)
        if key is not None:
            yield out()

    return areas


def replicate_auroc(counted: DataFrame, models: dict[str, str]) -> DataFrame:
    """Tie-aware AUROC of each model (name -> score column) and replicate: (model, replicate, metric).

    A range's area is that among its own rows plus its negatives times the positives of the ranges above it.
    """
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("prob")) for m, c in models.items()]))
    vector, wide = _vectors(counted)
    long = counted.select(named.alias("m"), "y", "chunk", vector).select("m.model", "chunk", "m.prob", "y", vector)
    order = [F.col("model"), F.col("chunk"), F.col("prob").desc_nulls_last()]
    ranged = long.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    sums = pinned(ranged.mapInArrow(_areas(wide), _SUMS))
    each = sums.select("model", "chunk", "part", F.posexplode(F.arrays_zip("pos", "neg", "area")).alias("at", "s"))
    each = each.select("model", (F.col("chunk") * CHUNK + F.col("at")).alias("replicate"), "part", "s.*")
    above = Window.partitionBy("model", "replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    each = each.withColumn("above", F.coalesce(F.sum("pos").over(above), F.lit(0.0)))
    found = F.try_divide(F.sum(F.col("area") + F.col("neg") * F.col("above")), F.sum("pos") * F.sum("neg"))
    return each.groupBy("model", "replicate").agg(found.alias("metric"))


def replicate_rates(counted: DataFrame, rates: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Shares of each replicate: (rate, replicate, metric), by name the drawn rows of the first condition over those of the second."""
    names, n = list(rates), len(rates)
    flags = F.array(*[F.coalesce(c, F.lit(False)).cast("int") for pair in rates.values() for c in pair])

    vector, wide = _vectors(counted)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            flagged = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 2 * n).astype(float)
            for chunk in np.unique(chunks):
                of = np.flatnonzero(chunks == chunk)
                for at in range(0, len(of), _BLOCK // CHUNK):
                    rows = of[at : at + _BLOCK // CHUNK]
                    found = flagged[rows].T @ unpacked(batch.column(1).take(pa.array(rows)), wide).astype(float)
                    held[chunk] = held[chunk] + found if chunk in held else found
        for chunk, found in held.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * n), "rate": names, "hits": list(found[0::2]), "base": list(found[1::2])})

    parts = counted.select("chunk", vector, flags.alias("flags")).mapInArrow(sums, "chunk long, rate string, hits array<double>, base array<double>")
    each = parts.select("rate", "chunk", F.posexplode(F.arrays_zip("hits", "base")).alias("at", "s"))
    found = F.try_divide(F.sum("s.hits"), F.sum("s.base"))
    return each.groupBy("rate", (F.col("chunk") * CHUNK + F.col("at")).alias("replicate")).agg(found.alias("metric"))
