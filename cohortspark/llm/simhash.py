"""SimHash near-duplicates by segment bit counts on a grid.

Method. A fingerprint's 64 bits form 32 segments of two; the embedding maps it to the 32 bit counts (0, 1 or 2). The
Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints. The segments form G
groups; a Manhattan distance of at most D leaves at least G - D groups unchanged, so two near fingerprints share the
grid cell of at least one choice of G - D groups (the cell is their counts). Each cell compares its members: pairs
whose Manhattan distance is at most D are verified exactly by the differing bits. G follows from the number of
distinct fingerprints, as a trade of copies per fingerprint against partners per cell; every G finds every link.

Only distinct fingerprints are compared, so a group of exact copies is one member. Cells above ``TILE`` members are
cut into tiles by hash and each pair of tiles is one unit of work, so that no task holds more than two tiles; a unit
returns a forest of its links, not all of them. A link is returned by the first cell choice that holds both ends.

Cases. A null or empty text, or one of white space, has fingerprint zero and is linked like any other. A null doc_id
is a document too: its component is the least doc_id it reaches, null if it reaches none. Repeated rows are kept and
get equal results. An empty table gives an empty result. Columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import shingles
from cohortspark.llm.components import connected_components, least_reachable
from cohortspark.llm.shared import bounded_batches, fresh, staged

WORDS = 4
MAX_BITS = 4
SEED = 42
#: Members of a cell that one unit of work compares with as many others.
TILE = 1024
#: Up to so many large cells, their table (24 bytes a row) is sent to every task; else it is joined by a shuffle.
BROADCAST_CELLS = 50_000
_SEGMENTS = 32
_LOW = 0x5555555555555555
_BLOCK = 65_536
_SMALL = 64


def fingerprint_bytes(text: str | None, words: int = WORDS, seed: int = SEED) -> bytes:
    """The fingerprint as 8 bytes, highest bit first."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not found:
        return bytes(8)
    line = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    size = min(words, len(found))
    ends, starts = ends[size - 1 :], starts[: len(found) - size + 1]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _BLOCK):
        part = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)
        hashes = b"".join([digest(line[s:e], seed) for s, e in part])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(starts)).tobytes()


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint_bits", words: int = WORDS) -> DataFrame:
    """``docs`` and the fingerprint of each text as a signed long."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        found = b"".join([fingerprint_bytes(t, words) for t in texts])
        return pd.Series(np.frombuffer(found, ">i8").astype(np.int64))

    return docs.withColumn(name, fingerprint(F.col(text)))


def as_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def segment_counts(bits: Column) -> Column:
    """32 two-bit fields with the bit count of each segment."""
    high, low = F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(_LOW)), bits.bitwiseAND(F.lit(_LOW))
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseXOR(low))


def _groups_for(n: int, max_bits: int) -> int:
    """The number of groups with the least work per fingerprint: copies (64 each) plus expected partners.

    With one group more than bits, a single choice keeps only 13 bits of counts; the range starts above that.
    """
    def work(groups: int) -> float:
        keys = comb(groups, max_bits)
        return keys * 64 + keys * n * 0.375 ** (_SEGMENTS * (groups - max_bits) / groups)

    return min(range(max_bits + 2, max_bits + 7), key=work)


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _group_masks(groups: int) -> list[int]:
    masks = []
    for g in range(groups):
        first, end = g * _SEGMENTS // groups, (g + 1) * _SEGMENTS // groups
        masks.append(((1 << 2 * (end - first)) - 1) << 2 * first)
    return masks


def _counts(bits: np.ndarray) -> np.ndarray:
    high, low = (bits >> np.uint64(1)) & np.uint64(_LOW), bits & np.uint64(_LOW)
    return ((high & low) << np.uint64(1)) | (high ^ low)


def _near(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Manhattan distance of segment counts first, then the exact number of differing bits."""
    apart = _counts(x) ^ _counts(y)
    high, low = (apart >> np.uint64(1)) & np.uint64(_LOW), apart & np.uint64(_LOW)
    near = np.bitwise_count(high) + np.bitwise_count(high ^ low) <= max_bits
    near[near] = np.bitwise_count(x[near] ^ y[near]) <= max_bits
    return near


def _owned(x: np.ndarray, y: np.ndarray, key: np.ndarray, masks: list[int], first_key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the first cell choice that holds both ends."""
    apart, same = _counts(x) ^ _counts(y), np.zeros(len(x), np.int64)
    for g, mask in enumerate(masks):
        same |= ((apart & np.uint64(mask)) == 0).astype(np.int64) << g
    return first_key[same] == key


def link_forest(reps: DataFrame, bits: str, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links of at most ``max_bits``."""
    groups = _groups_for(reps.count(), max_bits)
    masks = _group_masks(groups)
    keys = list(combinations(range(groups), groups - max_bits))
    first_key = np.full(1 << groups, -1)
    for mask in range(1 << groups):
        first_key[mask] = next((k for k, key in enumerate(keys) if all(mask >> g & 1 for g in key)), -1)
    cells = [
        F.struct(F.lit(k).alias("k"), F.col("counts").bitwiseAND(F.lit(_signed(sum(masks[g] for g in key)))).alias("cell"))
        for k, key in enumerate(keys)
    ]
    base = reps.select(F.col(bits).alias("fp")).withColumn("counts", segment_counts(F.col("fp")))
    keyed = base.select("fp", F.explode(F.array(*cells)).alias("c")).select("fp", "c.k", "c.cell")
    sizes = keyed.groupBy("k", "cell").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    sizes = staged(sizes.select("k", "cell", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_CELLS else sizes.hint("merge")
    tiled = keyed.join(sizes, ["k", "cell"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pair = F.least("tile", "other").cast("long") * F.lit(1 << 31) + F.greatest("tile", "other")
    dealt = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("k", "cell", pair.alias("pair"), "tile", "fp")
    dealt = dealt.repartition("k", "cell", "pair").sortWithinPartitions("k", "cell", "pair")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            now = {c: batch[c].to_numpy() for c in batch.columns}
            if rest is not None:
                now = {c: np.concatenate([rest[c], now[c]]) for c in now}
            new = np.ones(len(now["fp"]), bool)
            if len(new) == 0:
                continue
            new[1:] = (np.diff(now["k"]) != 0) | (np.diff(now["cell"]) != 0) | (np.diff(now["pair"]) != 0)
            last = int(np.flatnonzero(new)[-1])
            rest = {c: v[last:] for c, v in now.items()}
            yield from links({c: v[:last] for c, v in now.items()}, new[:last])
        if rest is not None:
            new = np.zeros(len(rest["fp"]), bool)
            new[:1] = True
            yield from links(rest, new)

    def edges(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def links(rows: dict[str, np.ndarray], new: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(new) < 2:
            return
        fp, key = rows["fp"].astype(np.int64).view(np.uint64), rows["k"]
        starts = np.flatnonzero(new)
        run, length = np.cumsum(new) - 1, np.diff(np.append(starts, len(new)))
        within = (rows["pair"] >> 31) == (rows["pair"] & (2**31 - 1))
        small = np.flatnonzero((length[run] <= _SMALL) & (length[run] > 1) & within)
        x, of, by = fp[small], run[small], key[small]
        for step in range(1, _SMALL):
            both = np.flatnonzero(of[step:] == of[:-step]) if step < len(of) else []
            if len(both) == 0:
                break
            p, q = x[both], x[both + step]
            near = _near(p, q, max_bits)
            p, q = p[near], q[near]
            owned = _owned(p, q, by[both][near], masks, first_key)
            if owned.any():
                yield edges(p[owned], q[owned])
        for r in np.flatnonzero(length > 1):
            at, end = starts[r], starts[r] + length[r]
            if length[r] <= _SMALL and within[at]:
                continue
            members, side = fp[at:end], rows["tile"][at:end]
            one = np.flatnonzero(side == side.min())
            two = one if within[at] else np.flatnonzero(side != side.min())
            found = []
            for i in range(0, len(one), 256):
                p, q = np.broadcast_arrays(members[one[i : i + 256], None], members[two][None, :])
                p, q = p.ravel(), q.ravel()
                hit = np.flatnonzero(_near(p, q, max_bits))
                hit = hit[_owned(p[hit], q[hit], np.full(len(hit), key[at]), masks, first_key)]
                found.append((one[i + hit // max(len(two), 1)], two[hit % max(len(two), 1)]))
            a, b = (np.concatenate(z) for z in zip(*found, strict=True))
            label = least_reachable(a, b, len(members))
            moved = np.flatnonzero(label != np.arange(len(members)))
            if len(moved):
                yield edges(members[moved], members[label[moved]])

    return dealt.mapInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS, words: int = WORDS
) -> DataFrame:
    """One row per document: doc_id, fingerprint_bits and component_id (the least doc_id of its component)."""
    marked = with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words)
    return with_components(staged(marked.select("doc_id", "fingerprint_bits")), max_bits)


def with_components(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``marked`` (doc_id, fingerprint_bits, ...; a written table) with component_id."""
    return joined_components(marked, "fingerprint_bits", lambda reps: link_forest(reps, "fingerprint_bits", max_bits))


def joined_components(marked: DataFrame, node: str, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``marked`` (doc_id, the column ``node``, ...) with component_id; ``links`` makes edges from the distinct nodes."""
    reps = marked.groupBy(node).agg(F.min("doc_id").alias("least_id"))
    reps = staged(reps)
    linked = connected_components(links(reps))
    linked = staged(linked.select(F.col("node").alias(node), "root").join(reps.hint("merge"), node))
    least = staged(linked.groupBy("root").agg(F.min("least_id").alias("component_id")))
    of = linked.join(least.hint("merge"), "root").select(node, F.col("component_id").alias("joined_id"))
    of = reps.join(staged(of).hint("merge"), node, "left")
    of = staged(of.select(node, F.coalesce("joined_id", "least_id").alias("component_id")))
    return marked.join(of.hint("merge"), node)


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """``docs`` (doc_id, text and others) with one row of each component: that of the least doc_id.

    Links are fingerprints of at most ``max_bits`` differing bits or, if ``similarity`` is given, sets of word shingles
    of at least that Jaccard similarity: candidates are then what such fingerprints join and what shares a cell of least
    hashes, and all of them are compared by their whole sets. Rows that share the least doc_id compare by a hash of all columns; rows equal
    in every column count as one.
    """
    hashed, count = fresh(docs, "row_hash"), fresh(docs, "row_count")
    keyed = docs.withColumn(hashed, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    thin = keyed.select("doc_id", F.col(hashed).alias("row_hash"), "text")
    if similarity is None:
        node = "fingerprint_bits"
        parts = with_components(staged(with_fingerprints(thin, words=words).drop("text")), max_bits)
    else:
        node, marked = "set_key", staged(shingles.with_cells(with_fingerprints(thin, words=words), words).drop("text"))
        texts = thin.select("row_hash", "text")
        # The empty set is like no other set.
        prints = marked.where(F.size("cells") > 0).select(F.col("set_key").alias("doc_id"), "fingerprint_bits").distinct()
        near = with_components(staged(prints), max_bits)
        near = staged(near.select(F.col("doc_id").alias("set_key"), F.col("component_id").alias("cell")))
        parts = joined_components(
            marked.drop("cells", "fingerprint_bits"), node, lambda _: shingles.link_forest(marked, texts, words, similarity, near)
        )
    first = parts.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")).alias("first")
    )
    # A component without any doc_id is known by its rows alone: all such rows share the null component.
    first = first.where(F.col("component_id").isNotNull()).select("first.doc_id", "first.row_hash")
    nameless = parts.where(F.col("component_id").isNull()).groupBy(node).agg(
        F.min("row_hash").alias("row_hash")
    )
    first = first.unionByName(nameless.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "row_hash"))
    repeats = parts.groupBy("doc_id", "row_hash").agg(F.count("*").alias("row_count"))
    chosen = first.join(repeats.hint("merge"), first.doc_id.eqNullSafe(repeats.doc_id) & (first.row_hash == repeats.row_hash))
    of = fresh(docs, "kept_id")
    chosen = staged(chosen.select(first.doc_id.alias(of), first.row_hash.alias(hashed), F.col("row_count").alias(count)).distinct())
    same = (keyed[hashed] == chosen[hashed]) & F.col("doc_id").eqNullSafe(F.col(of))
    kept = keyed.join(chosen.hint("shuffle_hash"), same).drop(of, chosen[hashed])
    once = kept.where(F.col(count) == 1).drop(hashed, count)
    again = kept.where(F.col(count) > 1).drop(hashed, count).distinct()
    return once.unionByName(again)
