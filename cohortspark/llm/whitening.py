"""Whitening of embeddings by their leading principal components, found by a block Jacobi-Davidson method.

Method. The covariance is never formed. It is applied to a few vectors at a time: the distinct vectors lie in blocks of
rows, each block is centred, multiplied by the vectors and by itself transposed, and the sums of all blocks come back.
The search starts from a seeded random block. A Rayleigh-Ritz step gives the wanted pairs of the subspace; a pair whose
residual is down to rounding is locked. Each other one is improved by its correction equation, projected against the
locked vectors and itself and solved by a few steps of MINRES; all equations of a round go in step, so that one pass
over the data serves them all. The solutions join the subspace, which starts again from its best vectors when it is
full. Rounds go on until every wanted pair is locked.

Whole numbers. A component c counts as floor(256 c). Sums, and the deviations n x - S of each row, are exact.

Cases. Rows whose vector is null, empty, or holds null or non-finite entries go; so do those with an entry of 2**55 or
more, whose whole number has no 64 bits, and those of another length than most (the longer on ties). Equal vectors
count once in the fit and have rows of their own in the result, as have repeated rows; a null vec_id stays null. Equal
eigenvalues have any orthogonal vectors of their space. Components without variance (fewer distinct vectors than
components, constant dimensions) have no rows; an empty table gives an empty result. Extra columns are not read,
whatever their names. ``deviation`` is null beyond 38 digits.

Scale. A pass reads the distinct vectors once and returns dimensions x vectors numbers a task, summed by the driver or,
where they are many, in a tree. The driver holds the subspace: dimensions times some tens of columns. Copies meet before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.shared import staged

#: Whole numbers in 1, and bits that they must stay below.
UNIT, BITS = 256, 63
COMPONENTS = 4
#: Bytes of a block of rows.
BLOCK_BYTES = 4 << 20
#: Bytes of sums that the driver takes at once.
GATHERED = 64 << 20
#: Columns that the subspace starts with and has at most, steps of an inner solve, rounds.
START, MOST, INNER, ROUNDS = 8, 32, 12, 200
#: A residual counts as zero below so many units of rounding of the largest eigenvalue.
RESIDUAL = 64 * np.finfo(float).eps


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, embedding) that can be used: vec_id and x, an array of whole numbers of one length."""
    limit = float(2 ** (BITS - 8))
    usable = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("c"))
    rows = rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & F.coalesce(usable, F.lit(False)))
    rows = rows.select("vec_id", F.transform("c", lambda v: F.floor(v * UNIT).cast("long")).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    return rows.where(F.size("x") == (first["dim"] if first else 0))


@dataclass
class FitList:
    """The distinct vectors in blocks of rows, their number, exact sums and largest absolute entry."""

    blocks: RDD
    dim: int
    n: int
    sums: list[int]
    largest: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def summed(self, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all blocks of what a block (rows of whole numbers) gives."""
        dim = self.dim
        parts = self.blocks.map(lambda b: of_block(_rows(b, dim)))
        # One sum a task comes to the driver where they fit in there, else they meet in a tree of tasks first.
        few = self.blocks.getNumPartitions() * dim * MOST * 8 <= GATHERED
        return parts.reduce(np.add) if few else parts.treeReduce(np.add)

    def covariance_times(self, vectors: np.ndarray) -> np.ndarray:
        """The covariance (divisor n) times each column, centred before multiplying."""
        mean = self.mean

        def product(rows: np.ndarray) -> np.ndarray:
            centred = rows - mean
            return centred.T @ (centred @ vectors)

        return self.summed(product) / self.n


def _rows(block: bytes, dim: int) -> np.ndarray:
    """The rows of a block, whose first byte is the width of its numbers."""
    return np.frombuffer(block, f"<i{block[0]}", offset=1).reshape(-1, dim)


def _block(rows: np.ndarray) -> bytes:
    most = int(np.abs(rows).max(initial=0))
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return bytes([width]) + rows.astype(f"<i{width}").tobytes()


def fit_list(rows: DataFrame) -> FitList | None:
    """The distinct vectors of ``rows`` (x); None if there are none."""
    first = rows.select(F.size("x").alias("dim")).first()
    if first is None:
        return None
    dim = first["dim"]
    most = max(1, BLOCK_BYTES // (8 * dim))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), most):
                block = np.stack(batch["x"].iloc[at : at + most].to_list()).astype(np.int64)
                # Halves of 32 bits add up without overflow over two thousand million rows.
                high, low = block >> 32, block & 0xFFFFFFFF
                sums = np.stack([high.sum(0), low.sum(0)]).tobytes()
                yield pd.DataFrame({"block": [_block(block)], "sums": [sums], "n": [len(block)], "largest": [int(np.abs(block).max())]})

    packed = rows.groupBy("x").agg(F.lit(1).alias("one")).select("x").mapInPandas(pack, "block binary, sums binary, n long, largest long")
    packed = staged(packed)
    facts = packed.agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).first()
    blocks = packed.select("block").rdd.map(lambda r: bytes(r[0]))
    halves = packed.select("sums").rdd.map(lambda r: np.frombuffer(r[0], np.int64).reshape(2, dim)).treeReduce(np.add)
    sums = [int(h) * 2**32 + int(low) for h, low in halves.T]
    return FitList(blocks, dim, facts["n"], sums, facts["largest"])


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal to the bases and to each other; what nothing is left of goes."""
    kept = np.zeros((len(new), 0))
    for column in new.T:
        length = np.linalg.norm(column)
        if not np.isfinite(length) or length == 0:
            continue
        column = column / length
        for _ in range(3):  # a repeated Gram-Schmidt step takes what rounding left
            for basis in (*bases, kept):
                column = column - basis @ (basis.T @ column)
            length = np.linalg.norm(column)
            if length < 1e-12:
                break
            column = column / length
        else:
            kept = np.column_stack([kept, column])
    return kept


def minres(times: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, reduction: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one a column, all in step: ``times`` applies each column's own matrix."""
    x, last_v, v = np.zeros_like(right), np.zeros_like(right), right.copy()
    beta = np.linalg.norm(v, axis=0)
    first = beta.copy()
    live = beta > 0
    safe = lambda d: np.where(d == 0, 1.0, d)
    v = v / safe(beta)
    w1, w2 = np.zeros_like(right), np.zeros_like(right)
    eta, c0, c1, s0, s1, beta = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        # Lanczos step.
        u = times(v) - beta * last_v
        alpha = (u * v).sum(0)
        u = u - alpha * v
        after = np.linalg.norm(u, axis=0)
        # Givens rotations of the tridiagonal matrix.
        delta = c1 * alpha - c0 * s1 * beta
        r1, r2, r3 = np.hypot(delta, after), s1 * alpha + c0 * c1 * beta, s0 * beta
        c0, c1, s0, s1 = c1, delta / safe(r1), s1, after / safe(r1)
        w = (v - r3 * w1 - r2 * w2) / safe(r1)
        x = x + np.where(live & (r1 > 0), c1 * eta, 0.0) * w
        eta = -s1 * eta
        live &= (r1 > 0) & (np.abs(eta) > reduction * first) & (after > 1e-14 * first)
        last_v, v, beta, w1, w2 = v, u / safe(after), after, w2, w
    return x


def leading_components(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors (columns) of a symmetric matrix given by its products."""
    wanted = min(wanted, dim)
    space = _orthonormal(np.random.default_rng(seed).standard_normal((dim, min(dim, max(START, 2 * wanted)))))
    image = times(space)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    best = np.inf
    stalled = 0
    for turn in range(ROUNDS):
        small = space.T @ image
        theta, inner = np.linalg.eigh((small + small.T) / 2)
        theta, inner = theta[::-1], inner[:, ::-1]
        left = min(wanted - locked.shape[1], space.shape[1])
        ritz = space @ inner[:, :left]
        residual = image @ inner[:, :left] - ritz * theta[:left]
        residual -= locked @ (locked.T @ residual)
        scale = max(np.abs(values).max(initial=0), abs(theta[0]))
        norms = np.linalg.norm(residual, axis=0)
        # Only pairs before the first open one are locked, so that they are the largest.
        worst = norms.max(initial=0)
        stalled = stalled + 1 if worst > 0.5 * best else 0
        best = min(best, worst)
        limit = RESIDUAL * scale
        if stalled >= 4 and best < 1e3 * limit:
            limit = 2 * best  # rounding of the products themselves allows no less
        n_done = int(np.argmin(np.append(norms <= limit, False)))
        full = locked.shape[1] + space.shape[1] >= dim
        if full:  # the subspace is everything: its pairs are exact
            n_done = left
        if n_done:
            locked = np.column_stack([locked, _orthonormal(ritz[:, :n_done], locked)])
            values = np.append(values, theta[:n_done])
            best, stalled = np.inf, 0
        if locked.shape[1] >= wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        rest = inner[:, n_done:]
        if space.shape[1] - n_done + left > MOST:
            rest = rest[:, :START]
        ritz, residual, shift = ritz[:, n_done:], residual[:, n_done:], theta[n_done:left]
        space, image = space @ rest, image @ rest

        def corrected(z: np.ndarray, ritz=ritz, shift=shift, locked=locked) -> np.ndarray:
            """Each column through its own projected, shifted matrix."""
            out = lambda y: (lambda y: y - ritz * (ritz * y).sum(0))(y - locked @ (locked.T @ y))
            z = out(z)
            return out(times(z) - z * shift)

        more = minres(corrected, -residual, min(INNER, 1 + turn), 0.5 ** (turn + 1))
        more = _orthonormal(np.column_stack([more, residual]) if turn == 0 else more, locked, space)
        if more.shape[1] == 0:  # corrections that lie in the subspace: go on from new directions
            more = _orthonormal(np.random.default_rng(seed + 1 + turn).standard_normal((dim, left)), locked, space)
        space, image = np.column_stack([space, more]), np.column_stack([image, times(more)])
    raise RuntimeError(f"the leading components were not found to rounding in {ROUNDS} rounds")


@dataclass
class Whitening:
    """Components of a fit list: eigenvalues, vectors (columns), the share of the variance, and what identity lacks."""

    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(found: FitList, components: int = COMPONENTS) -> Whitening:
    """The leading components with variance, of ``components`` at most."""
    mean, dim = found.mean, found.dim
    trace = float(found.summed(lambda rows: np.array(((rows - mean) ** 2).sum()))) / found.n
    if trace == 0:
        return Whitening(np.zeros(0), np.zeros((dim, 0)), np.zeros(0), 0.0)
    values, vectors = leading_components(found.covariance_times, dim, components)
    some = values > trace * dim * np.finfo(float).eps
    values, vectors = values[some], vectors[:, some]
    scaled = vectors / np.sqrt(values)
    centre = found.summed(lambda rows: ((rows - mean) @ scaled).sum(0)) / found.n

    def products(rows: np.ndarray) -> np.ndarray:
        white = (rows - mean) @ scaled - centre
        return white.T @ white

    identity = found.summed(products) / found.n
    return Whitening(values, vectors, values / trace, float(np.abs(identity - np.eye(len(values))).max()))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained and identity_error.

    vectors: vec_id, embedding (array of numbers).
    """
    spark = vectors.sparkSession
    rows = staged(whole_numbers(vectors))
    found = fit_list(rows)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    columns = f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if found is None:
        return spark.createDataFrame([], columns)
    model = fit(found, components)
    n, sums, scaled = found.n, found.sums, model.vectors / np.sqrt(model.values)
    # |n x - S| is at most 2 n times the largest entry; beyond 64 bits Python's whole numbers take over.
    short = found.dim * (2 * n * found.largest) ** 2 < 2**BITS
    shift = np.array(sums, np.int64 if short else object)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_list())
            off = (x if short else x.astype(object)) * n - shift
            deviation = [str(v) for v in (off * off).sum(1).tolist()]
            white = (off.astype(float) / n) @ scaled
            yield pd.DataFrame({"vec_id": batch["vec_id"], "deviation": deviation, "w": list(white)})

    out = rows.mapInPandas(project, f"vec_id {id_type}, deviation string, w array<double>")
    out = out.select("vec_id", F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), F.posexplode("w").alias("k", "whitened"))
    share = F.get(F.array(*[F.lit(float(v)) for v in model.explained]) if len(model.explained) else F.array().cast("array<double>"), F.col("k"))
    return out.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
