"""Data-quality gates: each is one aggregate row (gate, passed, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.evaluation import mean_difference


def gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check: the aggregate column counts offending rows, 0 passes. All checks share one pass."""
    counted = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("n_bad")) for n in checks])
    flat = counted.select(F.explode(rows).alias("g")).select("g.*")
    return flat.select("gate", (F.col("n_bad") == 0).alias("passed"), "n_bad")


def cohort_checks(lead_s: float) -> dict[str, Column]:
    """Checks on a cohort with label, onset_time, prediction_time, intime, outtime, suspicion_time, score parts and total."""
    positive, control = F.col("label") == 1, F.col("label") == 0
    parts = ["part_a", "part_b", "part_c"]
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    gap = F.col("onset_time") - F.col("suspicion_time")
    return {
        "duplicate_stays": F.count("stay_id") - F.count_distinct("stay_id"),
        "prediction_is_onset_less_lead": F.count_if(positive & (F.abs(F.col("onset_time") - lead_s - F.col("prediction_time")) > 1e-6)),
        "prediction_inside_stay": F.count_if(~F.col("prediction_time").between(F.col("intime"), F.col("outtime"))),
        "onset_near_suspicion": F.count_if(positive & ~gap.between(-48 * 3600.0, 24 * 3600.0)),
        "parts_in_range": F.count_if(F.greatest(*parts) > 4) + F.count_if(F.least(*parts) < 0),
        "total_in_range": F.count_if(positive & ~F.col("total").between(2, 24)),
        "total_is_sum": F.count_if(F.col("total") != total),
        "control_at_discharge": F.count_if(control & (F.col("prediction_time") == F.col("outtime"))),
        "control_tail_margin": F.count_if(control & (F.col("outtime") - F.col("prediction_time") < lead_s)),
        "control_has_onset": F.count_if(control & F.col("onset_time").isNotNull()),
        "both_arms_present": F.lit(2) - F.count_distinct("label"),
    }


def leakage(cohort: DataFrame) -> DataFrame:
    """Subjects that stand in more than one split."""
    return cohort.groupBy("subject_id").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def component_sum(rows: DataFrame, value: str = "gcs", low: float = 3, high: float = 15) -> DataFrame:
    """One gate: the sum of a scale's components lies within its range wherever it is known."""
    return gates(rows, {f"{value}_in_range": F.count_if(~F.col(value).between(low, high))})


def balance(rows: DataFrame, arm: str, value: str, limit: float = 0.1) -> DataFrame:
    """One gate: the standardised mean difference of the arms is below ``limit``; (gate, passed, smd)."""
    smd = mean_difference(rows, arm, value).select("smd")
    return smd.select(F.lit("offset_balance").alias("gate"), F.coalesce(F.abs("smd") < limit, F.lit(False)).alias("passed"), "smd")


def guarded_window(rows: DataFrame, lookback_hours: float, hours: str = "hours_before") -> DataFrame:
    """``rows``, raising where one lies after the prediction or before the look-back window."""
    after = F.raise_error(F.lit("an event lies after the prediction")).cast("double")
    older = F.raise_error(F.lit("an event is older than the look-back window")).cast("double")
    checked = F.when(F.col(hours) < 0, after).when(F.col(hours) > lookback_hours + 1e-9, older).otherwise(F.col(hours))
    return rows.withColumn(hours, checked)


def matching_report(matched: DataFrame, lead: float) -> DataFrame:
    """Requested, matched and unmatched offsets, matches that break the tail margin, and the arms' offset difference."""
    taken = F.when(F.col("control_id").isNotNull(), F.col("offset"))
    spread = F.sqrt((F.var_pop("offset") + F.var_pop(taken)) / 2)
    gap = F.avg("offset") - F.avg(taken)
    return matched.agg(
        F.count("*").alias("requested"),
        F.count("control_id").alias("matched"),
        F.count_if(F.col("control_id").isNull()).alias("unmatched"),
        F.count_if(F.col("capacity") < F.col("offset") + lead).alias("tail_violations"),
        F.when(spread > 0, gap / spread).when(gap == 0, 0.0).alias("smd"),
    )
