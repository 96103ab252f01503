"""The model input of a cohort in one call: hourly series of several modalities, a static block, labels.

A series has one aggregate for each stay and concept, with a slot for each hour: there is no table of all stays, concepts
and hours, no join to it and no window. What is carried forward is a fold over the slots. Events are joined to the
cohort by stay, and everything after that stays in the same partitions. Concepts, columns and their train statistics
are parameters' size and travel as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.features import time_index, varying_columns
from cohortspark.sources.staging import pinned

#: Spreads below this count as none.
LEAST_SPREAD = 1e-8


@dataclass(frozen=True)
class Modality:
    """Long rows (stay_id, concept, value, hours_before), the concepts in the order of the tensor, those that are summed."""

    rows: DataFrame
    concepts: tuple[str, ...]
    cumulative: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Bundle:
    """``rows``: stay_id, label, in_train, static (array) and, for each modality, an array of hours of channels.

    An hour has value, mask and delta of each concept in order. ``scale`` holds (mean, spread) of each modality and
    concept, ``static_columns`` and ``static_scale`` those of the static block.
    """

    rows: DataFrame
    scale: dict[str, dict[str, tuple[float, float]]]
    static_columns: list[str]
    static_scale: list[tuple[float, float]]


def _scale(mean: float | None, spread: float | None) -> tuple[float, float]:
    return mean or 0.0, 1.0 if spread is None or spread < LEAST_SPREAD else spread


def slots(modality: Modality, cohort: DataFrame, bins: int) -> DataFrame:
    """stay_id, concept, in_train, s1, s2 and n (sums and count of the raw values) and v: an hour's mean or sum, or null.

    cohort: stay_id, in_train. Raises for events after the prediction.
    """
    late = F.raise_error(F.concat(F.lit("event after the prediction of stay "), F.col("stay_id").cast("string"))).cast("double")
    rows = modality.rows.where(F.col("concept").isin(*modality.concepts) & F.col("value").isNotNull() & F.col("hours_before").isNotNull())
    rows = rows.select("stay_id", "concept", F.col("value").cast("double").alias("value"), F.when(F.col("hours_before") < -1e-6, late).otherwise(F.col("hours_before")).alias("h"))
    rows = rows.join(cohort.select("stay_id", "in_train").hint("merge"), "stay_id").withColumn("t", time_index(F.col("h"), bins))
    summed = F.col("concept").isin(*modality.cumulative) if modality.cumulative else F.lit(False)
    here = [F.when(F.col("t") == k, F.col("value")) for k in range(bins)]
    hours = F.array(*[F.when(F.first(summed), F.sum(v)).otherwise(F.avg(v)) for v in here])
    # Moments of the raw values in one numerically sound pass: mean and population variance of each stay and concept.
    return rows.groupBy("stay_id", "concept").agg(
        F.first("in_train").alias("in_train"), F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), hours.alias("v")
    )


def _logs(v: Column) -> Column:
    return F.transform(v, lambda x: F.log1p(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))))


def series_scale(filled: DataFrame, modality: Modality, n_train: int, bins: int) -> dict[str, tuple[float, float]]:
    """Mean and spread on training stays: of raw values, or for summed concepts of all training hours, empty ones too."""
    fit = filled.where("in_train")
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    raw = fit.groupBy("concept").agg(n.alias("n"), mean.alias("mean"), F.sum(F.col("n") * (F.col("variance") + F.col("mean") ** 2)).alias("s2"))
    add = lambda v, f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))
    logs = fit.groupBy("concept").agg(
        F.sum(add(_logs(F.col("v")), lambda x: x)).alias("l1"), F.sum(add(_logs(F.col("v")), lambda x: x * x)).alias("l2")
    )
    found = {r["concept"]: r for r in raw.join(logs.hint("merge"), "concept").collect()}  # one row a concept
    out = {}
    for c in modality.concepts:
        r = found.get(c)
        if r is None:
            out[c] = (0.0, 1.0)
            continue
        count, s1, s2 = (n_train * bins, r["l1"], r["l2"]) if c in modality.cumulative else (r["n"], r["n"] * r["mean"], r["s2"])
        m = s1 / count
        out[c] = _scale(m, max(0.0, s2 / count - m * m) ** 0.5)
    return out


def _channels(v: Column, mean: float, spread: float, summed: bool, bins: int) -> Column:
    """Value, mask and delta of each hour from the slots of one concept (null: no event in the window)."""
    if summed:
        values = F.transform(_logs(v), lambda x: (x - mean) / spread)
    else:
        carried = F.aggregate(
            v,
            F.struct(F.array().cast("array<double>").alias("out"), F.lit(mean).alias("last")),
            lambda a, x: F.struct(F.array_append(a["out"], (F.coalesce(x, a["last"]) - mean) / spread).alias("out"), F.coalesce(x, a["last"]).alias("last")),
        )
        values = carried["out"]
    since = F.aggregate(
        v,
        F.struct(F.array().cast("array<double>").alias("out"), F.lit(float(bins)).alias("last")),
        lambda a, x: F.struct(
            F.array_append(a["out"], F.when(x.isNotNull(), 0.0).otherwise(F.least(a["last"] + 1, F.lit(float(bins)))) / bins).alias("out"),
            F.when(x.isNotNull(), 0.0).otherwise(F.least(a["last"] + 1, F.lit(float(bins)))).alias("last"),
        ),
    )["out"]
    mask = F.transform(v, lambda x: x.isNotNull().cast("double"))
    return F.arrays_zip(values.alias("value"), mask.alias("mask"), since.alias("delta"))


def tensor(filled: DataFrame, modality: Modality, scale: dict[str, tuple[float, float]], bins: int) -> DataFrame:
    """stay_id and x: for each hour the channels of all concepts in order."""
    none = F.array_repeat(F.lit(None).cast("double"), bins)
    each = {c: F.first(F.when(F.col("concept") == c, F.col("v")), ignorenulls=True).alias(f"v{i}") for i, c in enumerate(modality.concepts)}
    rows = filled.groupBy("stay_id").agg(*each.values())
    parts = [_channels(F.coalesce(F.col(f"v{i}"), none), *scale[c], c in modality.cumulative, bins).alias(f"c{i}") for i, c in enumerate(modality.concepts)]
    rows = rows.select("stay_id", *parts)
    hour = lambda t: F.flatten(F.array(*[F.array(F.col(f"c{i}")[t]["value"], F.col(f"c{i}")[t]["mask"], F.col(f"c{i}")[t]["delta"]) for i in range(len(parts))]))
    return rows.select("stay_id", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), hour).alias("x"))


def _empty_tensor(modality: Modality, scale: dict[str, tuple[float, float]], bins: int) -> Column:
    """The tensor of a stay without events."""
    hour = []
    for c in modality.concepts:
        mean, spread = scale[c]
        hour += [-mean / spread if c in modality.cumulative else 0.0, 0.0, 1.0]
    return F.array_repeat(F.array(*map(F.lit, hour)), bins)


def grid_bundle(
    cohort: DataFrame, modalities: dict[str, Modality], static: DataFrame, train: DataFrame, subset: DataFrame | None = None, bins: int = 24
) -> Bundle:
    """The bundle of a cohort (stay_id, label), or of those of its stays that are in ``subset`` (stay_id).

    Every statistic is taken on the stays of ``train`` (stay_id) that are in the cohort; raises if there are none.
    static: stay_id and numbers, one row a stay; columns that do not vary on training stays go, missing numbers become
    the training mean. Stays without static row or events have the values of missing ones. Concepts that are not
    declared are left out.
    """
    stays = cohort.where("stay_id is not null and label is not null").groupBy("stay_id").agg(F.min("label").alias("label"))
    if subset is not None:
        stays = stays.join(subset.select("stay_id").distinct().hint("merge"), "stay_id", "left_semi")
    known = train.select("stay_id").distinct().withColumn("in_train", F.lit(True))
    stays = stays.join(known.hint("merge"), "stay_id", "left").withColumn("in_train", F.coalesce("in_train", F.lit(False)))
    stays = pinned(stays)
    n_train = stays.where("in_train").count()
    if n_train == 0:
        raise ValueError("no training stay is in the cohort; nothing to take statistics on")
    # Static block.
    block = static.withColumnRenamed("stay_id", "_stay").join(stays.hint("merge"), F.col("_stay") == F.col("stay_id"), "right").drop("_stay", "label")
    block = pinned(block)
    columns = varying_columns(block.where("in_train").drop("in_train"), F.lit(True))
    figures = block.where("in_train").agg(
        F.lit(0).alias("_"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]
    ).first()
    static_scale = [_scale(figures[f"m{i}"], figures[f"s{i}"]) for i in range(len(columns))]
    numbers = [(F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s for c, (m, s) in zip(columns, static_scale, strict=True)]
    rows = stays.join(block.select("stay_id", (F.array(*numbers) if numbers else F.array().cast("array<double>")).alias("static")).hint("merge"), "stay_id")
    # Series.
    scales = {}
    for name, modality in modalities.items():
        filled = pinned(slots(modality, stays, bins))
        scales[name] = series_scale(filled, modality, n_train, bins)
        found = tensor(filled, modality, scales[name], bins).withColumnRenamed("x", name)
        rows = rows.join(found.hint("merge"), "stay_id", "left").withColumn(name, F.coalesce(name, _empty_tensor(modality, scales[name], bins)))
    return Bundle(rows, scales, columns, static_scale)


def _cell(modality: str, unit: str, i: int):
    """The ``i``-th concept of an hour and its place as a row."""

    def cell(x: Column, t: Column) -> Column:
        value, mask, delta = x[3 * i], x[3 * i + 1].cast("int"), x[3 * i + 2]
        return F.struct(
            F.lit(modality).alias("modality"), F.lit(unit).alias("unit"), t.cast("int").alias("t"), value.alias("value"), mask.alias("mask"), delta.alias("delta")
        )

    return cell


def bundle_cells(bundle: Bundle, modalities: dict[str, Modality]) -> DataFrame:
    """The bundle as long rows: stay_id, label, modality, unit, t, value, mask, delta (static: t, mask and delta null)."""
    null = lambda kind: F.lit(None).cast(kind)
    units = [
        F.struct(F.lit("static").alias("modality"), F.lit(c).alias("unit"), null("int").alias("t"), F.col("static")[i].alias("value"), null("int").alias("mask"), null("double").alias("delta"))
        for i, c in enumerate(bundle.static_columns)
    ]
    parts = [F.array(*units)] if units else []
    for name, modality in modalities.items():
        for i, c in enumerate(modality.concepts):
            parts.append(F.transform(name, _cell(name, c, i)))
    return bundle.rows.select("stay_id", "label", F.explode(F.concat(*parts)).alias("cell")).select("stay_id", "label", "cell.*")
