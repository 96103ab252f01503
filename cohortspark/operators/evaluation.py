"""Evaluation of predictions: rows (keys..., y 0/1, prob). Every function works on all runs at once, by ``keys``.

Scores are summed by distinct probability before anything is ordered. Running totals go over ranges of runs and scores:
a run of all rows is split over tasks, a thousand small ones share some.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.operators.ordering import GROUPS, global_running, group_quantiles, running_within
from cohortspark.sources.staging import pinned


def score_groups(preds: DataFrame, keys: list[str], times: str | None = None) -> DataFrame:
    """Per distinct score: positives and negatives, and their running totals from the highest score.

    times: a column that says how often a row counts, as the counts of bootstrap replicates do.
    """
    often = F.col(times) if times else F.lit(1)
    groups = preds.groupBy(*keys, "prob").agg(F.sum(F.col("y") * often).cast("long").alias("pos"), F.sum((1 - F.col("y")) * often).cast("long").alias("neg"))
    if not keys:
        return global_running(groups, [F.col("prob").desc()], {"tp": "pos", "fp": "neg"})
    return running_within(groups, keys, [F.col("prob").desc()], {"tp": "pos", "fp": "neg"})


def _with_totals(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``score_groups`` with the totals n_pos and n_neg of the run, one row of which a run travels."""
    groups = pinned(groups)
    totals = groups.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    if not keys:
        return groups.crossJoin(F.broadcast(totals))  # one row
    totals = pinned(totals)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    few = totals.limit(GROUPS + 1).count() <= GROUPS
    return groups.join(F.broadcast(totals) if few else totals.hint("merge"), same).drop(*[f"_{k}" for k in keys])


def auroc(preds: DataFrame, keys: list[str], times: str | None = None) -> DataFrame:
    """Tie-aware area under the ROC curve; null for runs of one class."""
    g = score_groups(preds, keys, times)
    above = F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2)
    return g.groupBy(*keys).agg(F.try_divide(F.sum(above), F.sum("pos") * F.sum("neg")).alias("auroc"))


def auprc(preds: DataFrame, keys: list[str], times: str | None = None) -> DataFrame:
    """Average precision: precision at each distinct score times the recall it adds."""
    g = score_groups(preds, keys, times)
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return g.groupBy(*keys).agg(F.try_divide(F.sum(step), F.sum("pos")).alias("auprc"))


def curve_points(preds: DataFrame, keys: list[str]) -> DataFrame:
    """ROC and precision-recall points at each distinct score."""
    g = _with_totals(score_groups(preds, keys), keys)
    return g.select(
        *keys,
        F.col("prob").alias("threshold"),
        F.try_divide("fp", "n_neg").alias("fpr"),
        F.try_divide("tp", "n_pos").alias("tpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )


def pick_threshold(preds: DataFrame, keys: list[str], method: str = "youden") -> DataFrame:
    """The threshold with the best Youden's J (highest on ties) or the best F1 (lowest on ties)."""
    g = _with_totals(score_groups(preds, keys), keys)
    if method == "youden":
        # Ties are exact in whole numbers: tp * n_neg - fp * n_pos.
        gain, order = F.col("tp") * F.col("n_neg") - F.col("fp") * F.col("n_pos"), F.col("prob")
    elif method == "f1":
        gain, order = F.round(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n_pos")), 12), -F.col("prob")
    else:
        raise ValueError(method)
    return g.groupBy(*keys).agg(F.max_by("prob", F.struct(gain, order)).alias("threshold"))


def ppv_at(sensitivity: Column, specificity: Column, prevalence: Column | float) -> Column:
    """Positive predictive value at another prevalence, by Bayes; null where nothing would be flagged."""
    p = prevalence if isinstance(prevalence, Column) else F.lit(prevalence)
    hit = sensitivity * p
    flagged = hit + (1 - specificity) * (1 - p)
    return F.try_divide(hit, F.when(flagged != 0, flagged))


def confusion(preds: DataFrame, thresholds: DataFrame | float, keys: list[str]) -> DataFrame:
    """Counts and derived metrics at a threshold (prob >= threshold is an alarm), by run."""
    rows = preds.withColumn("threshold", F.lit(thresholds)) if isinstance(thresholds, float) else preds.join(F.broadcast(thresholds), keys) if keys else preds.crossJoin(F.broadcast(thresholds))
    alarm, positive = F.col("prob") >= F.col("threshold"), F.col("y") == 1
    counts = rows.groupBy(*keys, "threshold").agg(
        F.count_if(alarm & positive).alias("n_tp"),
        F.count_if(alarm & ~positive).alias("n_fp"),
        F.count_if(~alarm & ~positive).alias("n_tn"),
        F.count_if(~alarm & positive).alias("n_fn"),
    )
    tp, fp, tn, fn = (F.col(f"n_{c}") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    se, sp = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    rated = counts.withColumns({"sensitivity": se, "specificity": sp})
    s, c = F.col("sensitivity"), F.col("specificity")
    return rated.withColumns(
        {
            "ppv": F.try_divide(tp, tp + fp),
            "npv": F.try_divide(tn, tn + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
            "youden": s + c - 1,
            "balanced_accuracy": (s + c) / 2,
            "prevalence": (tp + fn) / n,
            "alarm_rate": (tp + fp) / n,
            "ppv_5": ppv_at(s, c, 0.05),
            "ppv_10": ppv_at(s, c, 0.10),
        }
    )


def calibration_error(preds: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins [low, high), the last one closed; edges are i / bins."""
    bin_ = F.lit(bins - 1)
    for i in range(bins - 1, 0, -1):
        bin_ = F.when(F.col("prob") < F.lit(i / bins), i - 1).otherwise(bin_)
    # The ladder is built from the top edge down, so the lowest edge is tested first.
    cells = preds.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("p"), F.avg("y").alias("q"))
    return cells.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("q"))) / F.sum("n")).alias("ece"))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Linear quantiles of a column; none where it has no values."""
    found = group_quantiles(df.select(value), [], value, {f"q{i}": q for i, q in enumerate(shares)}).first()
    return [found[f"q{i}"] for i in range(len(shares))] if found and found["n"] else []


def calibration_quantiles(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Mean probability and positive share of quantile bins (right-closed, equal edges merge), one run."""
    edges = sorted(set(quantiles(preds, "prob", [i / bins for i in range(1, bins)])))
    bin_ = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("prob"))) if edges else F.lit(0)
    return preds.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("mean_prob"), F.avg("y").alias("share_positive"))


def quartile(df: DataFrame, value: str, name: str = "quartile") -> DataFrame:
    """``df`` with the right-closed quartile (1 to 4) of a value by linear quantiles."""
    edges = quantiles(df, value, [0.25, 0.5, 0.75]) or [0.0]
    return df.withColumn(name, 1 + F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(value))))


def interval(values: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """Percentile interval of bootstrap values."""
    low = (1 - level) / 2
    return values.groupBy(*keys).agg(
        F.percentile("metric", F.lit(low)).alias("ci_low"), F.percentile("metric", F.lit(1 - low)).alias("ci_high"), F.count("*").alias("n_valid")
    )


def paired_difference(values: DataFrame, model: str, a: str, b: str) -> DataFrame:
    """Interval and two-sided p (twice the smaller tail, 1 at most) of a's metric less b's, on equal draws."""
    both = values.groupBy("replicate").agg(
        (F.max(F.when(F.col(model) == a, F.col("metric"))) - F.max(F.when(F.col(model) == b, F.col("metric")))).alias("d")
    ).where("d is not null")
    tail = F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))
    return both.agg(
        F.avg("d").alias("mean_difference"),
        F.percentile("d", F.lit(0.025)).alias("ci_low"),
        F.percentile("d", F.lit(0.975)).alias("ci_high"),
        F.least(2 * tail, F.lit(1.0)).alias("p_value"),
    )


def paired_table(values: DataFrame) -> DataFrame:
    """``paired_difference`` of every two models of bootstrap values (model, replicate, metric)."""
    other = values.select("replicate", F.col("model").alias("model_b"), F.col("metric").alias("metric_b"))
    both = values.withColumnRenamed("model", "model_a").join(other.hint("merge"), "replicate").where("model_a < model_b")
    d = F.col("metric") - F.col("metric_b")
    tail = F.least(F.avg((d <= 0).cast("double")), F.avg((d >= 0).cast("double")))
    return both.groupBy("model_a", "model_b").agg(
        F.avg(d).alias("mean_difference"),
        F.percentile(d, F.lit(0.025)).alias("ci_low"),
        F.percentile(d, F.lit(0.975)).alias("ci_high"),
        F.least(2 * tail, F.lit(1.0)).alias("p_value"),
    )


def consistent(found: DataFrame, reported: DataFrame, tolerance: float) -> DataFrame:
    """model, metric, found, reported and whether they agree; a metric that one side lacks does not pass."""
    both = found.join(reported.hint("merge"), ["model", "metric"], "full")
    return both.withColumn("passed", F.coalesce(F.abs(F.col("found") - F.col("reported")) <= tolerance, F.lit(False)))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two prediction sets on shared ids: stay_id, y, prob_a, prob_b; raises where labels disagree."""
    joined = a.select("stay_id", F.col("y").alias("y_a"), F.col("prob").alias("prob_a")).join(
        b.select("stay_id", F.col("y").alias("y_b"), F.col("prob").alias("prob_b")), "stay_id"
    )
    same = F.when(F.col("y_a") == F.col("y_b"), F.col("y_a")).otherwise(F.raise_error(F.lit("labels disagree")).cast("int"))
    return joined.select("stay_id", same.alias("y"), "prob_a", "prob_b")


def mean_difference(rows: DataFrame, arm: str, value: str) -> DataFrame:
    """Standardised mean difference of two arms (1 and 0): population variances; without spread 0 if the means agree, else infinite."""
    of = lambda k: F.when(F.col(arm) == k, F.col(value))
    s = rows.agg(F.avg(of(1)).alias("m1"), F.avg(of(0)).alias("m0"), F.var_pop(of(1)).alias("v1"), F.var_pop(of(0)).alias("v0"))
    gap, spread = F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2)
    smd = F.when(spread > 0, gap / spread).when(gap == 0, 0.0).when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf")))
    return s.select("m1", "m0", smd.alias("smd"))


def seed_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Median run by auprc (position n // 2), mean and population deviation over seeds."""
    w = Window.partitionBy(*keys)
    ranked = runs.withColumns({"r": F.row_number().over(w.orderBy("auprc", "seed")) - 1, "n": F.count("*").over(w)})
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col("seed"))).alias("median_seed"),
        F.avg("auroc").alias("auroc_mean"),
        F.stddev_pop("auroc").alias("auroc_sd"),
        F.avg("auprc").alias("auprc_mean"),
        F.stddev_pop("auprc").alias("auprc_sd"),
    )


def permuted(rows: DataFrame, column: str, seed: int, repeat: int = 0) -> DataFrame:
    """``rows`` (row_no 0..n-1 and others) with one column's values dealt anew: row i gets that of the i-th row in hash order."""
    order = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.lit(repeat).cast("string"), F.col("row_no").cast("string")))
    ranked = rows.select("row_no", F.col(column).alias("new_value"), order.alias("o"), F.lit(1).cast("long").alias("one"))
    ranked = global_running(ranked, [F.col("o"), F.col("row_no")], {"to": "one"})
    moved = ranked.select((F.col("to") - 1).alias("row_no"), "new_value")
    return rows.join(moved, "row_no").withColumn(column, F.col("new_value")).drop("new_value")
