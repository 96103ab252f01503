"""Queries of the evaluation stage: metrics, thresholds, calibration, resampling, models, incremental export."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import evaluation as E
from cohortspark.operators import models as M
from cohortspark.operators import resampling as R
from cohortspark.operators.cohort import assign_splits
from cohortspark.operators.ordering import global_running, group_quantiles
from cohortspark.operators.timeops import point_window
from cohortspark.plans.inputs import CONCEPTS, PR, SG, WIN, points, predictions, r6, stays, table
from cohortspark.plans.registry import query
from cohortspark.plans.sourcing import folder
from cohortspark.sources.staging import pinned
from cohortspark.sources.tables import read_predictions, run_index, write_predictions
from cohortspark.streaming.export import stream_export

AUC = "sum(neg * (tp - pos + pos / 2.0)) / (max(n_pos) * max(n_neg))"
AP = "sum(pos * tp / (tp + fp)) / max(n_pos)"


@query("auroc", "WITH " + SG + f" SELECT round({AUC}, 6) AS auroc FROM sg")
def auroc(spark, sf_dir):
    """Tie-aware AUROC."""
    return E.auroc(predictions(spark, sf_dir), []).select(r6("auroc").alias("auroc"))


@query("auprc", "WITH " + SG + f" SELECT round({AP}, 6) AS auprc FROM sg")
def auprc(spark, sf_dir):
    """Average precision."""
    return E.auprc(predictions(spark, sf_dir), []).select(r6("auprc").alias("auprc"))


@query("roc_points", "WITH " + SG + " SELECT prob AS threshold, round(fp / n_neg, 6) AS fpr, round(tp / n_pos, 6) AS tpr FROM sg")
def roc_points(spark, sf_dir):
    """ROC points."""
    return E.curve_points(predictions(spark, sf_dir), []).select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("pr_points", "WITH " + SG + " SELECT prob AS threshold, round(tp / n_pos, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM sg")
def pr_points(spark, sf_dir):
    """Precision-recall points."""
    return E.curve_points(predictions(spark, sf_dir), []).select("threshold", r6("tpr").alias("recall"), r6("precision").alias("precision"))


YOUDEN = "(SELECT arg_max(prob, (tp * n_neg - fp * n_pos, prob)) FROM sg)"
F1 = "(SELECT arg_max(prob, (round(2 * tp / (tp + fp + n_pos), 12), -prob)) FROM sg)"


@query("threshold_youden", "WITH " + SG + f" SELECT {YOUDEN} AS threshold")
def threshold_youden(spark, sf_dir):
    """Best Youden's J."""
    return E.pick_threshold(predictions(spark, sf_dir), [], "youden")


@query("threshold_f1", "WITH " + SG + f" SELECT {F1} AS threshold")
def threshold_f1(spark, sf_dir):
    """Best F1."""
    return E.pick_threshold(predictions(spark, sf_dir), [], "f1")


METRICS = ["sensitivity", "specificity", "ppv", "npv", "f1", "youden", "balanced_accuracy", "prevalence", "alarm_rate", "ppv_5", "ppv_10"]
RATES = """, r AS (SELECT *, n_tp / (n_tp + n_fn) AS se, n_tn / (n_tn + n_fp) AS sp FROM cm)
, me AS (SELECT *, round(se, 6) AS sensitivity, round(sp, 6) AS specificity, round(CASE WHEN n_tp + n_fp > 0 THEN n_tp / (n_tp + n_fp) END, 6) AS ppv, round(CASE WHEN n_tn + n_fn > 0 THEN n_tn / (n_tn + n_fn) END, 6) AS npv,
  round(2.0 * n_tp / (2 * n_tp + n_fp + n_fn), 6) AS f1, round(se + sp - 1, 6) AS youden, round((se + sp) / 2, 6) AS balanced_accuracy,
  round((n_tp + n_fn) / (n_tp + n_fp + n_tn + n_fn), 6) AS prevalence, round((n_tp + n_fp) / (n_tp + n_fp + n_tn + n_fn), 6) AS alarm_rate,
  round(CASE WHEN se * 0.05 + (1 - sp) * 0.95 > 0 THEN se * 0.05 / (se * 0.05 + (1 - sp) * 0.95) END, 6) AS ppv_5,
  round(CASE WHEN se * 0.10 + (1 - sp) * 0.90 > 0 THEN se * 0.10 / (se * 0.10 + (1 - sp) * 0.90) END, 6) AS ppv_10 FROM r)"""
COUNTS = "count(*) FILTER (a AND y = 1)::DOUBLE AS n_tp, count(*) FILTER (a AND y = 0)::DOUBLE AS n_fp, count(*) FILTER (NOT a AND y = 0)::DOUBLE AS n_tn, count(*) FILTER (NOT a AND y = 1)::DOUBLE AS n_fn"
OUT = "n_tp::BIGINT AS n_tp, n_fp::BIGINT AS n_fp, n_tn::BIGINT AS n_tn, n_fn::BIGINT AS n_fn, " + ", ".join(METRICS)


def _rounded(df):
    return df.withColumns({c: r6(c) for c in METRICS})


@query("confusion_metrics", "WITH " + SG + f", cm AS (SELECT {YOUDEN} AS threshold, {COUNTS} FROM (SELECT *, prob >= {YOUDEN} AS a FROM pr))" + RATES + f" SELECT threshold, {OUT} FROM me")
def confusion_metrics(spark, sf_dir):
    """Counts and derived metrics at the chosen threshold."""
    preds = predictions(spark, sf_dir).select("y", "prob")
    return _rounded(E.confusion(preds, E.pick_threshold(preds, []), []))


@query(
    "ece",
    "WITH " + PR + ", b AS (SELECT (SELECT max(i) FROM range(10) t(i) WHERE i = 0 OR prob >= i / 10.0::DOUBLE) AS bin, prob, y FROM pr), c AS (SELECT bin, count(*) AS n, avg(prob) AS p, avg(y) AS q FROM b GROUP BY 1) SELECT round(sum(n * abs(p - q)) / sum(n), 6) AS ece FROM c",
)
def ece(spark, sf_dir):
    """Expected calibration error."""
    return E.calibration_error(predictions(spark, sf_dir), []).select(r6("ece").alias("ece"))


@query(
    "calibration_quantile",
    "WITH " + PR + """, e AS (SELECT unnest(list_distinct(quantile_cont(prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edge FROM pr)
, b AS (SELECT (SELECT count(*) FROM e WHERE edge < prob)::INT AS bin, prob, y FROM pr) SELECT bin, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(avg(y), 6) AS share_positive FROM b GROUP BY 1""",
)
def calibration_quantile(spark, sf_dir):
    """Calibration curve on quantile bins."""
    return E.calibration_quantiles(predictions(spark, sf_dir)).select("bin", "n", r6("mean_prob").alias("mean_prob"), r6("share_positive").alias("share_positive"))


@query(
    "ppv_curve",
    "WITH " + SG + f", cm AS (SELECT {COUNTS} FROM (SELECT *, prob >= {YOUDEN} AS a FROM pr))" + RATES + """, p AS (SELECT i / 100.0::DOUBLE AS prevalence FROM range(1, 51) t(i))
SELECT p.prevalence, round(CASE WHEN se * p.prevalence + (1 - sp) * (1 - p.prevalence) > 0 THEN se * p.prevalence / (se * p.prevalence + (1 - sp) * (1 - p.prevalence)) END, 6) AS ppv FROM me, p""",
)
def ppv_curve(spark, sf_dir):
    """Predictive value over a range of prevalences."""
    preds = predictions(spark, sf_dir).select("y", "prob")
    row = E.confusion(preds, E.pick_threshold(preds, []), []).select("sensitivity", "specificity")
    grid = row.select("*", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("i")).withColumn("prevalence", F.col("i") / F.lit(100.0))
    return grid.select("prevalence", r6(E.ppv_at(F.col("sensitivity"), F.col("specificity"), F.col("prevalence"))).alias("ppv"))


@query(
    "clinical_rules",
    "WITH " + PR + f", cu AS (SELECT unnest([0.1, 0.2, 0.3, 0.5])::DOUBLE AS threshold), cm AS (SELECT threshold, {COUNTS} FROM (SELECT *, prob >= threshold AS a FROM pr, cu) GROUP BY 1)" + RATES + f" SELECT threshold, {OUT} FROM me",
)
def clinical_rules(spark, sf_dir):
    """Fixed cut-offs (four rows, so the product with them is bounded)."""
    cuts = spark.range(4).select(F.element_at(F.array(*map(F.lit, [0.1, 0.2, 0.3, 0.5])), (F.col("id") + 1).cast("int")).alias("threshold"))
    return _rounded(E.confusion(predictions(spark, sf_dir).select("y", "prob"), cuts, []))


@query(
    "threshold_report",
    "WITH " + SG + f", th AS (SELECT 'youden' AS method, {YOUDEN} AS threshold UNION ALL SELECT 'f1', {F1})"
    + f", cm AS (SELECT method, threshold, {COUNTS} FROM (SELECT *, prob >= threshold AS a FROM pr, th) GROUP BY 1, 2)" + RATES
    + " SELECT method, threshold, f1, round(2 * prevalence / (1 + prevalence), 6) AS trivial_f1, f1 - 2 * prevalence / (1 + prevalence) < 0.02 AS degenerate FROM me",
)
def threshold_report(spark, sf_dir):
    """Both criteria side by side with the F1 of flagging all."""
    preds = predictions(spark, sf_dir).select("y", "prob")
    both = [E.pick_threshold(preds, [], m).select(F.lit(m).alias("method"), "threshold") for m in ("youden", "f1")]
    thresholds = both[0].unionByName(both[1])
    rows = preds.crossJoin(F.broadcast(thresholds.select("method")))  # two rows
    rated = _rounded(E.confusion(rows, thresholds, ["method"]))
    trivial = 2 * F.col("prevalence") / (1 + F.col("prevalence"))
    return rated.select("method", "threshold", "f1", r6(trivial).alias("trivial_f1"), (F.col("f1") - trivial < 0.02).alias("degenerate"))


@query(
    "stratified_auroc",
    "WITH " + PR + """, q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS b, quantile_cont(n_chars, 0.75) AS c FROM pr)
, s AS (SELECT 'all' AS stratum, y, prob FROM pr UNION ALL SELECT 'lang ' || lang, y, prob FROM pr UNION ALL SELECT 'quartile ' || (1 + (n_chars > a)::INT + (n_chars > b)::INT + (n_chars > c)::INT), y, prob FROM pr, q)
, g AS (SELECT stratum, prob, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM s GROUP BY 1, 2)
, sg AS (SELECT *, sum(pos) OVER (PARTITION BY stratum ORDER BY prob DESC) AS tp, sum(pos) OVER (PARTITION BY stratum) AS n_pos, sum(neg) OVER (PARTITION BY stratum) AS n_neg FROM g)
SELECT stratum, sum(pos + neg)::BIGINT AS n, """ + f"round({AUC}, 6) AS auroc FROM sg GROUP BY 1 HAVING sum(pos + neg) >= 20 AND max(n_pos) > 0 AND max(n_neg) > 0",
)
def stratified_auroc(spark, sf_dir):
    """AUROC of the whole, by language and by length quartile; small or one-class strata drop out."""
    rows = E.quartile(predictions(spark, sf_dir), "n_chars")
    names = F.array(F.lit("all"), F.concat(F.lit("lang "), "lang"), F.concat(F.lit("quartile "), F.col("quartile").cast("string")))
    strata = rows.select(F.explode(names).alias("stratum"), "y", "prob")
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("n")).where("n >= 20")
    return sizes.join(E.auroc(strata, ["stratum"]).hint("merge"), "stratum").where("auroc is not null").select("stratum", "n", r6("auroc").alias("auroc"))


REPS, PAIRED_REPS = 1000, 2000


SEED, LEVELS = 2, 20  # of the SQL; a million groups at most


def _mixed_sql(source: str, x: str) -> str:
    """A subquery with column ``x`` of ``source`` put through the 32-bit mixer, step by step."""
    for step in ("xor({x}, {x} >> 16)", "({x} * 2246822507) % 4294967296", "xor({x}, {x} >> 13)", "({x} * 3266489909) % 4294967296", "xor({x}, {x} >> 16)"):
        source = f"(SELECT * REPLACE ({step.format(x=x)} AS {x}) FROM {source})"
    return source


def _uniform_sql(reps: int) -> str:
    """replicate, cut and u of every cut between two groups."""
    source = f"(SELECT r.i AS replicate, c.i AS cut, {SEED}::UBIGINT AS a, xor({SEED}::UBIGINT, 2654435769::UBIGINT) AS b FROM range({reps}) r(i), range(1, (SELECT gs FROM gn)) c(i))"
    for part in ("replicate", "cut % 4294967296", "cut // 4294967296"):
        source = _mixed_sql(f"(SELECT * REPLACE ((a + ({part})::UBIGINT) % 4294967296 AS a) FROM {source})", "a")
        source = _mixed_sql(f"(SELECT * REPLACE (xor(b, a) AS b) FROM {source})", "b")
    return f"SELECT replicate, cut, (b * 2097152 + (a >> 11)) / 9007199254740992.0 AS u FROM {source}"


def _level_sql(d: int) -> str:
    """Nodes of one level split over their halves; the distribution of each cut and number of draws is listed once."""
    return f""", n{d} AS MATERIALIZED (SELECT k.i, k.m, (((2 * k.i + 1) * gs) // {2 ** (d + 1)})::BIGINT AS cut, y.c - x.c AS wl, z.c - y.c AS wr
  FROM (SELECT DISTINCT i, m FROM l{d}) k, gn JOIN cb x ON x.b = (k.i * gs) // {2**d} JOIN cb y ON y.b = ((2 * k.i + 1) * gs) // {2 ** (d + 1)} JOIN cb z ON z.b = ((k.i + 1) * gs) // {2**d})
, t{d} AS MATERIALIZED (SELECT i, m, list(s ORDER BY k) AS upto FROM (SELECT i, m, k, sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(wl / (wl + wr)) + (m - k) * ln(wr / (wl + wr)))) OVER (PARTITION BY i, m ORDER BY k) AS s
  FROM (SELECT i, m, wl::DOUBLE AS wl, wr::DOUBLE AS wr, unnest(range(m + 1)) AS k FROM n{d} WHERE wl > 0 AND wr > 0)) GROUP BY 1, 2)
, k{d} AS MATERIALIZED (SELECT l.replicate, l.i, l.m, CASE WHEN n.wl = 0 THEN 0 WHEN n.wr = 0 THEN l.m ELSE least(l.m, len(list_filter(t.upto, lambda v: v <= us.u))) END AS k
  FROM l{d} l JOIN n{d} n ON n.i = l.i AND n.m = l.m LEFT JOIN t{d} t ON t.i = l.i AND t.m = l.m LEFT JOIN us ON us.replicate = l.replicate AND us.cut = n.cut AND n.wl > 0 AND n.wr > 0)
, l{d + 1} AS MATERIALIZED (SELECT * FROM (SELECT replicate, 2 * i AS i, k AS m FROM k{d} UNION ALL SELECT replicate, 2 * i + 1, m - k FROM k{d}) WHERE m > 0)"""


def _counts_sql(reps: int) -> str:
    """dr: the groups of scores and label with their counts (m) in each replicate, by the tree of binomials."""
    return (
        PR
        + f""", gr AS (SELECT prob, prob_b, y, count(*) AS w FROM pr WHERE y IS NOT NULL GROUP BY 1, 2, 3)
, gp AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS g, (sum(w) OVER w)::BIGINT - w AS c FROM gr WINDOW w AS (ORDER BY prob NULLS FIRST, prob_b NULLS FIRST, y))
, gn AS MATERIALIZED (SELECT count(*)::BIGINT AS gs, sum(w)::BIGINT AS n FROM gp)
, cb AS MATERIALIZED (SELECT g AS b, c FROM gp UNION ALL SELECT gs, n FROM gn)
, us AS MATERIALIZED ({_uniform_sql(reps)})
, l0 AS (SELECT r.i AS replicate, 0::BIGINT AS i, n AS m FROM range({reps}) r(i), gn)"""
        + "".join(map(_level_sql, range(LEVELS)))
        + f", dr AS MATERIALIZED (SELECT l.replicate, gp.prob, gp.prob_b, gp.y, l.m FROM l{LEVELS} l, gn JOIN gp ON gp.g = (l.i * gs) // {2**LEVELS})"
    )


def _draws_sql(reps: int = REPS) -> str:
    return _counts_sql(reps) + f""", pr2 AS (SELECT dr.replicate, m.model, dr.y, dr.m, CASE m.model WHEN 'a' THEN prob WHEN 'b' THEN prob_b ELSE (prob + prob_b) / 2 END AS prob FROM dr, (SELECT unnest(['a', 'b', 'c']) AS model) m)
, g AS (SELECT model, replicate, prob, sum(y * m)::BIGINT AS pos, sum((1 - y) * m)::BIGINT AS neg FROM pr2 GROUP BY 1, 2, 3)
, sg AS (SELECT *, sum(pos) OVER (PARTITION BY model, replicate ORDER BY prob DESC) AS tp, sum(pos) OVER (PARTITION BY model, replicate) AS n_pos, sum(neg) OVER (PARTITION BY model, replicate) AS n_neg FROM g)
, bs AS (SELECT model, replicate, {AUC} AS metric FROM sg GROUP BY 1, 2 HAVING max(n_pos) > 0 AND max(n_neg) > 0)"""


def _counted(spark, sf_dir, reps=REPS):
    """Groups of both scores and the label, with their counts in each replicate and the mean score."""
    preds = predictions(spark, sf_dir).select("prob", "prob_b", "y")
    return R.drawn(preds, ["prob", "prob_b", "y"], reps, SEED).withColumn("prob_c", (F.col("prob") + F.col("prob_b")) / 2)


def _bootstrap(spark, sf_dir, reps=REPS):
    counted = _counted(spark, sf_dir, reps)
    return pinned(R.replicate_auroc(counted, {"a": "prob", "b": "prob_b", "c": "prob_c"}).where("metric is not null"))


def _three_models(preds, *keys):
    """Long rows of the models a, b and c, their mean."""
    probs = {"a": F.col("prob"), "b": F.col("prob_b"), "c": (F.col("prob") + F.col("prob_b")) / 2}
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("prob")) for m, p in probs.items()])).alias("m")
    return preds.select(*keys, "y", models).select(*keys, "y", "m.model", "m.prob")


@query("bootstrap_ci", "WITH " + _draws_sql() + " SELECT model, round(quantile_cont(metric, 0.025), 6) AS ci_low, round(quantile_cont(metric, 0.975), 6) AS ci_high, count(*) AS n_valid FROM bs GROUP BY 1")
def bootstrap_ci(spark, sf_dir):
    """I4: percentile intervals of the AUROC for three models."""
    rows = E.interval(_bootstrap(spark, sf_dir), ["model"])
    return rows.select("model", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"), "n_valid")


@query(
    "paired_bootstrap",
    "WITH " + _draws_sql(PAIRED_REPS) + """, d AS (SELECT replicate, max(metric) FILTER (model = 'a') - max(metric) FILTER (model = 'b') AS d FROM bs GROUP BY 1)
SELECT round(avg(d), 6) AS mean_difference, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high, round(least(2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)), 1), 6) AS p_value FROM d""",
)
def paired_bootstrap(spark, sf_dir):
    """Difference of two models on equal draws."""
    rows = E.paired_difference(_bootstrap(spark, sf_dir, PAIRED_REPS), "model", "a", "b")
    return rows.select(*[r6(c).alias(c) for c in rows.columns])


@query(
    "paired_table",
    "WITH " + _draws_sql(PAIRED_REPS) + """, d AS (SELECT p.model AS model_a, q.model AS model_b, p.metric - q.metric AS d FROM bs p JOIN bs q ON p.replicate = q.replicate AND p.model < q.model)
SELECT model_a, model_b, round(avg(d), 6) AS mean_difference, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high, round(least(2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)), 1), 6) AS p_value FROM d GROUP BY 1, 2""",
)
def paired_table(spark, sf_dir):
    """Every pair of models on equal draws."""
    rows = E.paired_table(_bootstrap(spark, sf_dir, PAIRED_REPS))
    return rows.select("model_a", "model_b", *[r6(c).alias(c) for c in rows.columns if not c.startswith("model")])


THREE = PR + f""", lm AS (SELECT stay_id, y, prob, 'a' AS model FROM pr UNION ALL SELECT stay_id, y, prob_b, 'b' FROM pr UNION ALL SELECT stay_id, y, (prob + prob_b) / 2, 'c' FROM pr)
, lg AS (SELECT model, prob, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM lm GROUP BY 1, 2)
, ls AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY prob DESC) AS tp, sum(neg) OVER (PARTITION BY model ORDER BY prob DESC) AS fp, sum(pos) OVER (PARTITION BY model) AS n_pos, sum(neg) OVER (PARTITION BY model) AS n_neg FROM lg)
, lr AS (SELECT model, {AUC} AS auroc, {AP} AS auprc, any_value(n_pos) AS n_pos, any_value(n_pos) + any_value(n_neg) AS n FROM ls GROUP BY 1)"""


def _points(spark, sf_dir):
    rows = pinned(_three_models(predictions(spark, sf_dir), "stay_id"))
    counts = rows.groupBy("model").agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"))
    return counts.join(E.auroc(rows, ["model"]), "model").join(E.auprc(rows, ["model"]), "model")


@query(
    "model_table",
    "WITH " + _draws_sql() + ", ci AS (SELECT model, quantile_cont(metric, 0.025) AS low, quantile_cont(metric, 0.975) AS high FROM bs GROUP BY 1)" + THREE[len(PR):] + """
SELECT CASE model WHEN 'b' THEN 'random' ELSE 'classical' END AS arm, model, n, round(n_pos / n, 6) AS prevalence, round(auroc, 6) AS auroc, round(low, 6) AS ci_low, round(high, 6) AS ci_high, round(auprc, 6) AS auprc FROM lr JOIN ci USING (model)""",
)
def model_table(spark, sf_dir):
    """The models of both arms on shared columns, with intervals."""
    rows = _points(spark, sf_dir).join(E.interval(_bootstrap(spark, sf_dir), ["model"]).hint("merge"), "model")
    arm = F.when(F.col("model") == "b", "random").otherwise("classical").alias("arm")
    share = r6(F.col("n_pos") / F.col("n")).alias("prevalence")
    return rows.select(arm, "model", "n", share, *[r6(c).alias(c) for c in ("auroc", "ci_low", "ci_high", "auprc")])


CUTS = (0.1, 0.3, 0.5)
SCORES = {"length": "prob", "random": "prob_b", "mean": "prob_c"}


@query(
    "rule_intervals",
    "WITH " + _counts_sql(REPS) + """, rl AS (SELECT replicate, score, cut, sum(m * (s >= cut AND y = 1)::INT) / nullif(sum(m * y), 0) AS se FROM (
   SELECT replicate, y, m, unnest([{'score': 'length', 's': prob}, {'score': 'random', 's': prob_b}, {'score': 'mean', 's': (prob + prob_b) / 2}], recursive := true) FROM dr), (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS cut) GROUP BY 1, 2, 3)
SELECT score, cut, round(quantile_cont(se, 0.025), 6) AS ci_low, round(quantile_cont(se, 0.975), 6) AS ci_high FROM rl WHERE se IS NOT NULL GROUP BY 1, 2""",
)
def rule_intervals(spark, sf_dir):
    """Three scores at fixed cut-offs, with intervals of the sensitivity."""
    rules = {f"{n}:{c}": ((F.col(s) >= c) & (F.col("y") == 1), F.col("y") == 1) for n, s in SCORES.items() for c in CUTS}
    values = R.replicate_rates(_counted(spark, sf_dir), rules).where("metric is not null")
    rule = F.split("rate", ":")
    rows = E.interval(values.select(rule[0].alias("score"), rule[1].cast("double").alias("cut"), "metric"), ["score", "cut"])
    return rows.select("score", "cut", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"))


@query(
    "rule_table",
    "WITH " + _draws_sql() + ", ci AS (SELECT model, quantile_cont(metric, 0.025) AS low, quantile_cont(metric, 0.975) AS high FROM bs GROUP BY 1)" + THREE[len(PR):]
    + f", cu AS (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS threshold), cm AS (SELECT model, threshold, {COUNTS} FROM (SELECT *, prob >= threshold AS a FROM lm, cu) GROUP BY 1, 2)" + RATES
    + f" SELECT model, threshold, {OUT}, round(lr.auroc, 6) AS auroc, round(low, 6) AS ci_low, round(high, 6) AS ci_high FROM me JOIN lr USING (model) JOIN ci USING (model)",
)
def rule_table(spark, sf_dir):
    """Every count and ratio of three scores at fixed cut-offs, with the score's AUROC and its interval."""
    rows = pinned(_three_models(predictions(spark, sf_dir), "stay_id"))
    cuts = spark.createDataFrame([(m, c) for m in "abc" for c in CUTS], "model string, threshold double")
    rated = _rounded(E.confusion(rows, cuts, ["model"]))
    rates = E.auroc(rows, ["model"]).join(E.interval(_bootstrap(spark, sf_dir), ["model"]).hint("merge"), "model")
    return rated.join(rates.select("model", *[r6(c).alias(c) for c in ("auroc", "ci_low", "ci_high")]).hint("merge"), "model")


@query("align_predictions", "WITH " + PR + " SELECT stay_id, y, prob AS prob_a, prob_b FROM pr WHERE stay_id % 3 <> 0 AND stay_id % 5 <> 0")
def align_predictions(spark, sf_dir):
    """Two models' predictions on the ids that both have."""
    p = predictions(spark, sf_dir)
    b = p.where("stay_id % 5 <> 0").select("stay_id", "y", F.col("prob_b").alias("prob"))
    return E.aligned(p.where("stay_id % 3 <> 0").select("stay_id", "y", "prob"), b)


@query(
    "permute_column",
    "WITH " + PR + """, ix AS (SELECT *, row_number() OVER (ORDER BY stay_id) - 1 AS row_no FROM pr), o AS (SELECT *, row_number() OVER (ORDER BY md5('8:0:' || row_no), row_no) - 1 AS slot FROM ix)
SELECT ix.row_no, ix.y, o.prob FROM ix JOIN o ON o.slot = ix.row_no""",
)
def permute_column(spark, sf_dir):
    """One column dealt anew across all rows."""
    preds = predictions(spark, sf_dir).withColumn("one", F.lit(1).cast("long"))
    rows = global_running(preds, [F.col("stay_id")], {"n": "one"}).select((F.col("n") - 1).alias("row_no"), "y", "prob")
    return E.permuted(pinned(rows), "prob", 8).select("row_no", "y", "prob")


SEEDS = PR + """, sd AS (SELECT 'm' || (stay_id % 2) AS model, (stay_id % 5)::INT AS seed, avg(prob) AS auprc, avg(y) AS auroc FROM pr GROUP BY 1, 2)"""


@query(
    "seed_summary",
    "WITH " + SEEDS + """, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY auprc, seed) - 1 AS r, count(*) OVER (PARTITION BY model) AS n FROM sd)
SELECT model, max(CASE WHEN r = n // 2 THEN seed END) AS median_seed, round(avg(auroc), 6) AS auroc_mean, round(stddev_pop(auroc), 6) AS auroc_sd, round(avg(auprc), 6) AS auprc_mean, round(stddev_pop(auprc), 6) AS auprc_sd FROM r GROUP BY 1""",
)
def seed_summary(spark, sf_dir):
    """Median run and spread over seeds."""
    p = predictions(spark, sf_dir)
    runs = p.groupBy(F.concat(F.lit("m"), (F.col("stay_id") % 2).cast("string")).alias("model"), (F.col("stay_id") % 5).cast("int").alias("seed"))
    rows = E.seed_summary(runs.agg(F.avg("prob").alias("auprc"), F.avg("y").alias("auroc")), ["model"])
    return rows.select("model", "median_seed", *[r6(c).alias(c) for c in rows.columns if c not in ("model", "median_seed")])


@query(
    "top_features",
    "WITH " + WIN + """, i AS (SELECT stay_id % 4 AS model, concept, avg(value) AS importance FROM win GROUP BY 1, 2)
SELECT model, concept, round(importance, 6) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, concept) AS r FROM i) WHERE r <= 3""",
)
def top_features(spark, sf_dir):
    """H2: the k most important features of each model (k is the operator)."""
    from pyspark.sql.window import Window

    rows = point_window(points(spark, sf_dir), stays(spark, sf_dir))
    means = rows.groupBy((F.col("stay_id") % 4).alias("model"), "concept").agg(F.avg("value").alias("importance"))
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.col("importance").desc(), "concept"))
    return means.withColumn("r", rank).where("r <= 3").select("model", "concept", r6("importance").alias("importance"))


@query(
    "cohort_figures",
    "WITH " + WIN + " SELECT count(*) AS n, round(avg(label), 6) AS prevalence, round(median(CASE WHEN label = 1 THEN (outtime - t0) / 3600 END), 6) AS median_lead_h FROM st",
)
def cohort_figures(spark, sf_dir):
    """Size, prevalence and median lead of the positives."""
    lead = F.when(F.col("label") == 1, (F.col("outtime") - F.col("t0")) / 3600)
    rows = pinned(stays(spark, sf_dir).withColumn("lead", lead))
    median = group_quantiles(rows, [], "lead", {"median_lead_h": 0.5}).select(r6("median_lead_h").alias("median_lead_h"))
    return rows.agg(F.count("*").alias("n"), r6(F.avg("label")).alias("prevalence")).crossJoin(F.broadcast(median))  # one row each


def _all_metrics(rows):
    """model, metric and value: AUROC, AUPRC, calibration error, and predictive value at the model's own threshold."""
    rows = pinned(rows)
    rated = E.confusion(rows, E.pick_threshold(rows, ["model"]), ["model"])
    parts = [E.auroc(rows, ["model"]), E.auprc(rows, ["model"]), E.calibration_error(rows, ["model"]), rated.select("model", "ppv")]
    long = [p.select("model", F.lit(p.columns[1]).alias("metric"), F.col(p.columns[1]).alias("found")) for p in parts]
    return long[0].unionByName(long[1]).unionByName(long[2]).unionByName(long[3])


@query(
    "metric_consistency",
    "WITH " + THREE + """, th AS (SELECT model, arg_max(prob, (tp * n_neg - fp * n_pos, prob)) AS threshold FROM ls GROUP BY 1)
, lb AS (SELECT model, (SELECT max(i) FROM range(10) t(i) WHERE i = 0 OR prob >= i / 10.0::DOUBLE) AS bin, prob, y FROM lm)
, lc AS (SELECT model, bin, count(*) AS n, avg(prob) AS p, avg(y) AS q FROM lb GROUP BY 1, 2)
, v AS (SELECT model, 'auroc' AS metric, auroc AS v FROM lr UNION ALL SELECT model, 'auprc', auprc FROM lr UNION ALL SELECT model, 'ece', sum(n * abs(p - q)) / sum(n) FROM lc GROUP BY 1
  UNION ALL SELECT model, 'ppv', avg(y) FROM lm JOIN th USING (model) WHERE prob >= threshold GROUP BY 1)
SELECT model, metric, round(v, 6) AS found, NOT (model = 'b' AND metric = 'ece') AS passed FROM v""",
)
def metric_consistency(spark, sf_dir):
    """Four metrics of each model, computed again from stored predictions, against the table stored with them.

    One stored entry is off by a millionth, which the tolerance of 1e-9 must show.
    """
    top, rows = folder(spark), _three_models(predictions(spark, sf_dir), "stay_id")
    off = F.when((F.col("model") == "b") & (F.col("metric") == "ece"), 1e-6).otherwise(0.0)
    _all_metrics(rows).select("model", "metric", (F.col("found") + off).alias("reported")).write.parquet(f"{top}/reported")
    rows.repartition(7, "stay_id").write.parquet(f"{top}/predictions")
    again = _all_metrics(spark.read.parquet(f"{top}/predictions"))
    found = E.consistent(again, spark.read.parquet(f"{top}/reported"), 1e-9)
    return found.select("model", "metric", r6("found").alias("found"), "passed")


@query(
    "reported_runs",
    "WITH " + PR + ", s AS (SELECT stay_id, y, prob, (stay_id % 3)::INT AS seed FROM pr) SELECT stay_id, y, prob, seed FROM s WHERE seed = 1",
)
def reported_runs(spark, sf_dir):
    """Predictions written by run, and those behind the reported median seed."""
    p = predictions(spark, sf_dir)
    rows = p.select(F.lit("test").alias("split"), "stay_id", "y", "prob", F.lit("all").alias("ablation"), F.lit("a").alias("model"), (F.col("stay_id") % 3).cast("int").alias("seed"))
    path = f"{folder(spark)}/predictions"
    write_predictions(rows, path)
    metrics = rows.groupBy("ablation", "model").agg(F.median("seed").cast("int").alias("median_seed"))
    return run_index(read_predictions(spark, path), metrics).select("stay_id", "y", "prob", "seed")


def _matrix(spark, sf_dir):
    """Counts and means by concept, label and split of each user."""
    cohort = stays(spark, sf_dir).select("stay_id", F.col("stay_id").alias("subject_id"), "label")
    split = assign_splits(cohort).select("subject_id", "split")
    block = points(spark, sf_dir).groupBy("stay_id").pivot("concept", CONCEPTS).agg(F.count("value").alias("n"), F.avg("value").alias("m"))
    matrix, names = M.design_matrix([block], cohort.join(split, "subject_id").drop("subject_id"))
    matrix = matrix.withColumn("label", F.col("label").cast("double")).withColumn("one", F.lit(1).cast("long"))
    numbered = global_running(matrix, [F.col("stay_id")], {"row_no": "one"}).withColumn("row_no", F.col("row_no") - 1).drop("one")
    return M.with_weights(pinned(numbered), names), names


def ablations(names: list[str]) -> dict[str, list[str]]:
    """Eleven sets of columns: all, each statistic, all without a concept, and mixed ones; the last has no column."""
    counts, means = [n for n in names if n.endswith("_n")], [n for n in names if n.endswith("_m")]
    sets = {"all": names, "counts": counts, "means": means}
    sets |= {f"without_{c}": [n for n in names if not n.startswith(c)] for c in CONCEPTS}
    return sets | {"first": names[:2], "click_only": [n for n in names if n.startswith("click")], "empty": []}


@query("logreg_sweep")
def logreg_sweep(spark, sf_dir):
    """A logistic model of each ablation on every split; a run that fails is a row with its error."""
    matrix, names = _matrix(spark, sf_dir)
    n_train = matrix.where("split = 'train'").count()
    runs = {a: lambda used=used: M.logistic(used, n_train) for a, used in ablations(names).items()}
    scored, failed = M.sweep(runs, matrix)
    rates = E.auroc(pinned(scored), ["run", "split"]).withColumn("error", F.lit(None).cast("string"))
    return rates.unionByName(failed.select("run", F.lit(None).cast("string").alias("split"), F.lit(None).cast("double").alias("auroc"), "error"))


@query("validated_threshold")
def validated_threshold(spark, sf_dir):
    """K6: fitted on train, threshold chosen on val, metrics at it on test."""
    matrix, names = _matrix(spark, sf_dir)
    scored = pinned(M.predict(M.fit(M.logistic(names, matrix.where("split = 'train'").count()), matrix), matrix))
    threshold = E.pick_threshold(scored.where("split = 'val'"), []).first()["threshold"]
    return E.confusion(scored.where("split = 'test'"), float(threshold), []).select("threshold", "sensitivity", "specificity", "f1")


@query("margin_scores")
def margin_scores(spark, sf_dir):
    """K6: a classifier without probabilities is scored by its margin."""
    matrix, names = _matrix(spark, sf_dir)
    runs = {"svm": lambda: M.linear_margin(names, matrix.where("split = 'train'").count())}
    scored, _ = M.sweep(runs, matrix)
    return E.auroc(scored, ["run", "split"])


@query("boosted_trees")
def boosted_trees(spark, sf_dir):
    """K2, K3: boosted trees of 300 rounds, and of 400 with 0.8 of rows and columns."""
    matrix, names = _matrix(spark, sf_dir)
    fitted = M.fit_all([M.boosted(names, 300), M.boosted(names, 400, 0.8)], matrix)
    rows = [M.predict(m, matrix).withColumn("model", F.lit(model)) for m, model in zip(fitted, ("all_rows", "sampled"), strict=True)]
    return E.auprc(pinned(rows[0].unionByName(rows[1])), ["model", "split"])


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    """Drop of average precision per column and, moved together, per concept; 20 repeats."""
    matrix, names = _matrix(spark, sf_dir)
    model = M.fit(M.logistic(names, matrix.where("split = 'train'").count()), matrix)
    units = {n: [n] for n in names} | {f"concept {c}": [n for n in names if n.startswith(c)] for c in CONCEPTS}
    return M.permutation_importance(model, matrix, units, repeats=20, seed=1)


@query("stream_export", "WITH " + WIN + " SELECT event_id, stay_id, concept, value, round(hours_before, 6) AS hours_before FROM win")
def stream_export_query(spark, sf_dir):
    """The incremental export gives the rows of the batch export."""
    top = folder(spark)
    events = table(spark, sf_dir, "events")
    events.repartition(3).write.parquet(f"{top}/in")
    cohort = pinned(stays(spark, sf_dir).select("stay_id", "lower_bound", "t0"))
    stream_export(spark, f"{top}/in", events.schema, cohort, f"{top}/out", f"{top}/offsets")
    rows = spark.read.parquet(f"{top}/out")
    return rows.select("event_id", "stay_id", "concept", "value", r6("hours_before").alias("hours_before"))
