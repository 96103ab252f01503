"""Queries of the export and feature stages: windows, treatments, summaries, scores, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cohortspark.functions import clinical
from cohortspark.functions.columns import clip, prorated
from cohortspark.operators import bundle as B
from cohortspark.operators import features as X
from cohortspark.operators import timeops as T
from cohortspark.operators.cohort import filled_join, joined_once
from cohortspark.operators.evaluation import auroc
from cohortspark.operators.gates import gates
from cohortspark.operators.ordering import group_quantiles
from cohortspark.plans.inputs import EV, CONCEPTS, IV, WIN, intervals, points, r6, stays
from cohortspark.plans.registry import query
from cohortspark.sources.staging import pinned


def _window(spark, sf_dir):
    return T.point_window(points(spark, sf_dir), stays(spark, sf_dir))


def _intervals(spark, sf_dir):
    return T.interval_window(intervals(spark, sf_dir), stays(spark, sf_dir))


@query("cohort_window", "WITH " + WIN + " SELECT event_id, stay_id, concept, value, round(hours_before, 6) AS hours_before FROM win")
def cohort_window(spark, sf_dir):
    """D9, D11, C5, B17, S4g, A5: point events in their stay's closed window."""
    return _window(spark, sf_dir).select("event_id", "stay_id", "concept", "value", r6("hours_before").alias("hours_before"))


@query(
    "cohort_static",
    "WITH " + WIN + " SELECT stay_id, label, t0, lower_bound, round((t0 - intime) / 3600, 6) AS hours_since_admission, coalesce(c_nationkey, -1) AS nation FROM st LEFT JOIN customer ON c_custkey = stay_id",
)
def cohort_static(spark, sf_dir):
    """S4e, S4f, D4, B17: cohort rows with their static columns."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("stay_id"), "c_nationkey")
    rows = stays(spark, sf_dir).join(customer, "stay_id", "left")
    hours = r6((F.col("t0") - F.col("intime")) / 3600).alias("hours_since_admission")
    return rows.select("stay_id", "label", "t0", "lower_bound", hours, F.coalesce("c_nationkey", F.lit(-1)).alias("nation"))


@query(
    "interval_window",
    "WITH " + IV + " SELECT event_id, stay_id, observed_start, observed_end, round(observed_s, 3) AS observed_s, round(hours_before, 6) AS hours_before FROM iw",
)
def interval_window(spark, sf_dir):
    """Intervals clipped to the window."""
    rows = _intervals(spark, sf_dir)
    return rows.select("event_id", "stay_id", "observed_start", "observed_end", F.round("observed_s", 3).alias("observed_s"), r6("hours_before").alias("hours_before"))


TR = IV + """, tr AS (
  SELECT event_id, stay_id, 'fluid' AS concept, amount * CASE WHEN original_s > 0 THEN least(greatest(observed_s / original_s, 0), 1) ELSE 1 END AS value, observed_s, hours_before FROM iw WHERE concept = 'click'
  UNION ALL SELECT event_id, stay_id, 'vasopressor', amount / 1000, observed_s, hours_before FROM iw WHERE concept = 'purchase' AND amount IS NOT NULL
  UNION ALL SELECT ev.event_id, ev.stay_id, 'urine', ev.value, 0.0, (st.t0 - ev.charttime) / 3600.0 FROM ev JOIN st USING (stay_id) WHERE ev.concept = 'view' AND charttime BETWEEN lower_bound AND t0
  UNION ALL SELECT event_id, stay_id, 'antibiotic', 1.0, observed_s, hours_before FROM iw WHERE concept = 'signup')"""


def _treatments(spark, sf_dir, antibiotics=True):
    iw = _intervals(spark, sf_dir)
    columns = ["event_id", "stay_id", "concept", "value", "observed_s", "hours_before"]
    of = lambda c: iw.where(F.col("concept") == c)
    fluid = of("click").withColumns({"concept": F.lit("fluid"), "value": prorated(F.col("amount"), F.col("observed_s"), F.col("original_s"))})
    pressor = of("purchase").where("amount is not null").withColumns({"concept": F.lit("vasopressor"), "value": F.col("amount") / 1000})
    urine = _window(spark, sf_dir).where("concept = 'view'").withColumns({"concept": F.lit("urine"), "observed_s": F.lit(0.0)})
    parts = [fluid, pressor, urine]
    if antibiotics:  # for the sensitivity export only
        parts.append(of("signup").withColumns({"concept": F.lit("antibiotic"), "value": F.lit(1.0)}))
    return reduce(lambda a, b: a.unionByName(b), [p.select(*columns) for p in parts])


@query("union_treatments", "WITH " + TR + " SELECT event_id, stay_id, concept, round(value, 6) AS value, round(observed_s, 3) AS observed_s FROM tr")
def union_treatments(spark, sf_dir):
    """S4, S4a-S4d, B18: four treatment sources in one layout."""
    rows = _treatments(spark, sf_dir)
    return rows.select("event_id", "stay_id", "concept", r6("value").alias("value"), F.round("observed_s", 3).alias("observed_s"))


@query("fluid_prorate", "WITH " + TR + " SELECT event_id, round(value, 6) AS value FROM tr WHERE concept = 'fluid'")
def fluid_prorate(spark, sf_dir):
    """Fluid scaled to the observed part of its interval."""
    return _treatments(spark, sf_dir).where("concept = 'fluid'").select("event_id", r6("value").alias("value"))


@query("without_antibiotics", "WITH " + TR + " SELECT concept, count(*) AS n FROM tr WHERE concept <> 'antibiotic' GROUP BY 1")
def without_antibiotics(spark, sf_dir):
    """The primary export leaves the label's own source out."""
    return _treatments(spark, sf_dir, antibiotics=False).groupBy("concept").agg(F.count("*").alias("n"))


@query(
    "export_gates",
    "WITH " + TR + """ SELECT gate, n_bad = 0 AS passed, n_bad FROM (SELECT 'after_prediction' AS gate, count(*) FILTER (hours_before < 0) AS n_bad FROM tr WHERE concept <> 'antibiotic' OR event_id % 9 = 0
UNION ALL SELECT 'older_than_window', count(*) FILTER (hours_before > 24 + 1e-9) FROM tr WHERE concept <> 'antibiotic' OR event_id % 9 = 0 UNION ALL SELECT 'antibiotic_source', count(*) FROM tr WHERE concept = 'antibiotic' AND event_id % 9 = 0)""",
)
def export_gates(spark, sf_dir):
    """No event after the prediction or before the window, no antibiotic source."""
    rows = _treatments(spark, sf_dir).where("concept <> 'antibiotic' or event_id % 9 = 0")  # some were left in
    return gates(
        rows,
        {
            "after_prediction": F.count_if(F.col("hours_before") < 0),
            "older_than_window": F.count_if(F.col("hours_before") > 24 + 1e-9),
            "antibiotic_source": F.count_if(F.col("concept") == "antibiotic"),
        },
    )


LIMITS = [("click", 10.0, 400.0), ("view", 0.0, 300.0), ("signup", 50.0, 450.0)]


def _limits(spark):
    return spark.createDataFrame(LIMITS, "concept string, low double, high double")


@query(
    "value_limits",
    "WITH " + WIN + """, li AS (SELECT * FROM (VALUES ('click', 10.0, 400.0), ('view', 0.0, 300.0), ('signup', 50.0, 450.0)) t(concept, low, high))
SELECT event_id, concept, value FROM win LEFT JOIN li USING (concept) WHERE low IS NULL OR value BETWEEN low AND high""",
)
def value_limits(spark, sf_dir):
    """Values outside their concept's closed limits are missing, then dropped; concepts without limits pass."""
    rows = _window(spark, sf_dir).join(F.broadcast(_limits(spark)), "concept", "left")
    value = F.when(F.col("low").isNull() | F.col("value").between(F.col("low"), F.col("high")), F.col("value"))
    return rows.select("event_id", "concept", value.alias("value")).where("value is not null")


STATS = WIN + """, es AS (SELECT stay_id, concept, count(value) AS "count", 1 AS present, arg_min(value, (hours_before, event_id)) AS last, min(value) AS min, max(value) AS max,
  avg(value) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(value) END AS std,
  CASE WHEN isnan(regr_slope(value, hours_before)) THEN NULL ELSE regr_slope(value, hours_before) END AS slope FROM win GROUP BY 1, 2)"""


def _stats(spark, sf_dir):
    return X.eight_stats(_window(spark, sf_dir), ["event_id"])


@query(
    "eight_stats",
    "WITH " + STATS + " SELECT stay_id, concept, \"count\", present, last, min, max, round(mean, 6) AS mean, round(std, 6) AS std, round(slope, 6) AS slope FROM es",
)
def eight_stats(spark, sf_dir):
    """Eight statistics per stay and concept."""
    rounded = {c: r6(c) for c in ("mean", "std", "slope")}
    return _stats(spark, sf_dir).withColumns(rounded)


WIDE = ", ".join(
    f"max(CASE WHEN concept = '{c}' THEN {v} END) AS {c}__{s}"
    for c in CONCEPTS
    for s, v in (("count", '"count"'), ("present", "present"), ("last", "last"), ("min", "min"), ("max", "max"), ("mean", "round(mean, 6)"), ("std", "round(std, 6)"), ("slope", "round(slope, 6)"))
)


@query("wide_features", "WITH " + STATS + f", wi AS (SELECT stay_id, {WIDE} FROM es GROUP BY 1) SELECT * FROM (SELECT stay_id FROM st) LEFT JOIN wi USING (stay_id)")
def wide_features(spark, sf_dir):
    """One row per stay, a column per concept and statistic."""
    return X.wide(eight_stats(spark, sf_dir), stays(spark, sf_dir), CONCEPTS)


@query(
    "structural_zero",
    "WITH " + STATS + """ SELECT stay_id, coalesce(max(CASE WHEN concept = 'click' THEN "count" END), 0) AS click__count, coalesce(max(CASE WHEN concept = 'click' THEN present END), 0) AS click__present,
  max(CASE WHEN concept = 'click' THEN last END) AS click__last FROM st LEFT JOIN es USING (stay_id) GROUP BY 1""",
)
def structural_zero(spark, sf_dir):
    """Absence is 0 for counts and flags only."""
    matrix = X.fill_structural_zeros(X.wide(_stats(spark, sf_dir), stays(spark, sf_dir), ["click"]))
    return matrix.select("stay_id", "click__count", "click__present", "click__last")


SUMMARY = TR + """, su AS (SELECT stay_id, round(sum(CASE WHEN concept = 'fluid' THEN value END), 6) AS fluid_total, round(avg(CASE WHEN concept = 'vasopressor' THEN value END), 6) AS vasopressor_mean,
  round(max(CASE WHEN concept = 'vasopressor' THEN value END), 6) AS vasopressor_max, round(sum(CASE WHEN concept = 'urine' THEN value END), 6) AS urine_total FROM tr GROUP BY 1)"""


@query("treatment_summary", "WITH " + SUMMARY + " SELECT * FROM su")
def treatment_summary(spark, sf_dir):
    """Treatment sums and rates, null where there were none."""
    rows = X.treatment_summary(_treatments(spark, sf_dir))
    return rows.select("stay_id", *[r6(c).alias(c) for c in rows.columns if c != "stay_id"])


@query(
    "static_onehot",
    "SELECT doc_id, (lang IS NOT DISTINCT FROM 'en')::INT AS lang__en, (lang IS NOT DISTINCT FROM 'fr')::INT AS lang__fr, (lang IS NULL)::INT AS lang__missing, least(greatest(n_chars::DOUBLE, -10000), 10000) AS chars FROM documents",
)
def static_onehot(spark, sf_dir):
    """One-hot levels with a missing flag, finite and clipped numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    return X.one_hot(docs, "lang", ["en", "fr"]).select("doc_id", "lang__en", "lang__fr", "lang__missing", clip(F.col("n_chars").cast("double"), -1e4, 1e4).alias("chars"))


@query(
    "zero_variance",
    "WITH " + STATS + """, w AS (SELECT stay_id, max(CASE WHEN concept = 'click' THEN "count" END) AS click__count, max(CASE WHEN concept = 'click' THEN last END) AS click__last,
 max(CASE WHEN concept = 'error' THEN last END) AS error__last, 1 AS constant FROM st LEFT JOIN es USING (stay_id) GROUP BY 1)
, l AS (SELECT stay_id, 'click__count' AS name, click__count::DOUBLE AS v FROM w UNION ALL SELECT stay_id, 'click__last', click__last FROM w
 UNION ALL SELECT stay_id, 'error__last', error__last FROM w UNION ALL SELECT stay_id, 'constant', constant FROM w)
SELECT name, count(DISTINCT v) + max((v IS NULL)::INT) > 1 AS kept FROM l WHERE stay_id % 3 <> 0 GROUP BY 1""",
)
def zero_variance(spark, sf_dir):
    """Which columns vary on the training rows and stay."""
    wide = X.wide(_stats(spark, sf_dir), stays(spark, sf_dir), ["click", "error"], ["count", "last"]).withColumn("constant", F.lit(1))
    kept = X.varying_columns(wide, F.col("stay_id") % 3 != 0)
    names = ["click__count", "click__last", "error__last", "constant"]
    return spark.createDataFrame([(c, c in kept) for c in names], "name string, kept boolean")


SC0 = WIN + """, sc AS (SELECT stay_id,
  min(CASE WHEN concept = 'click' THEN value END) AS plt, max(CASE WHEN concept = 'signup' THEN value / 60 END) AS cre, min(CASE WHEN concept = 'view' THEN value / 4 END) AS map,
  max(CASE WHEN concept = 'purchase' THEN value / 1000 END) AS vaso, coalesce(sum(CASE WHEN concept = 'view' THEN value END), 0) AS uo, count(CASE WHEN concept = 'view' THEN value END) AS uo_n,
  min(CASE WHEN concept = 'error' THEN 3 + event_id % 13 END) AS gcs, arg_min(CASE WHEN concept = 'error' THEN 3 + event_id % 13 END, CASE WHEN concept = 'error' THEN (hours_before, event_id) END) AS gcs_last,
  max(CASE WHEN concept = 'click' THEN value / 10 END) AS rr, min(CASE WHEN concept = 'signup' THEN value END) AS sbp FROM win GROUP BY 1)
, so AS (SELECT stay_id, CASE WHEN plt < 20 THEN 4 WHEN plt < 50 THEN 3 WHEN plt < 100 THEN 2 WHEN plt < 150 THEN 1 ELSE 0 END AS coagulation,
  greatest(CASE WHEN cre >= 5 THEN 4 WHEN cre >= 3.5 THEN 3 WHEN cre >= 2 THEN 2 WHEN cre >= 1.2 THEN 1 ELSE 0 END, CASE WHEN uo_n > 0 AND uo < 200 THEN 4 WHEN uo_n > 0 AND uo < 500 THEN 3 ELSE 0 END) AS renal,
  CASE WHEN vaso > 0.1 THEN 4 WHEN vaso > 0 THEN 3 WHEN map < 70 THEN 1 ELSE 0 END AS cardiovascular,
  CASE WHEN gcs < 6 THEN 4 WHEN gcs < 10 THEN 3 WHEN gcs < 13 THEN 2 WHEN gcs < 15 THEN 1 ELSE 0 END AS nervous,
  CASE WHEN rr >= 22 THEN 1 ELSE 0 END + CASE WHEN gcs < 15 THEN 1 ELSE 0 END + CASE WHEN sbp <= 100 THEN 1 ELSE 0 END AS bedside,
  CASE WHEN rr >= 22 THEN 1 ELSE 0 END + CASE WHEN gcs_last < 15 THEN 1 ELSE 0 END + CASE WHEN sbp <= 100 THEN 1 ELSE 0 END AS bedside_last, plt, gcs FROM sc)"""


def _scores(spark, sf_dir):
    rows = _window(spark, sf_dir)
    of = lambda c, v=F.col("value"): F.when(F.col("concept") == c, v)
    gcs = (3 + F.col("event_id") % 13).cast("double")
    order = F.when(F.col("concept") == "error", F.struct("hours_before", "event_id"))
    comp = rows.groupBy("stay_id").agg(
        F.min(of("click")).alias("plt"), F.max(of("signup", F.col("value") / 60)).alias("cre"), F.min(of("view", F.col("value") / 4)).alias("map"),
        F.max(of("purchase", F.col("value") / 1000)).alias("vaso"), F.coalesce(F.sum(of("view")), F.lit(0.0)).alias("uo"), F.count(of("view")).alias("uo_n"),
        F.min(of("error", gcs)).alias("gcs"), F.min_by(gcs, order).alias("gcs_last"), F.max(of("click", F.col("value") / 10)).alias("rr"), F.min(of("signup")).alias("sbp"),
    )
    return comp.select(
        "stay_id", clinical.coagulation(F.col("plt")).alias("coagulation"), clinical.renal(F.col("cre"), F.col("uo"), F.col("uo_n")).alias("renal"),
        clinical.cardiovascular(F.col("map"), F.col("vaso")).alias("cardiovascular"), clinical.nervous(F.col("gcs")).alias("nervous"),
        clinical.bedside(F.col("rr"), F.col("gcs"), F.col("sbp")).alias("bedside"), clinical.bedside(F.col("rr"), F.col("gcs_last"), F.col("sbp")).alias("bedside_last"), "plt", "gcs",
    )


@query("scores_t0", "WITH " + SC0 + " SELECT stay_id, coagulation, renal, cardiovascular, nervous, coagulation + renal + cardiovascular + nervous AS total, bedside, bedside_last FROM so")
def scores_t0(spark, sf_dir):
    """Scores of the window before the prediction, worst and last variants."""
    s = _scores(spark, sf_dir)
    total = F.col("coagulation") + F.col("renal") + F.col("cardiovascular") + F.col("nervous")
    return s.select("stay_id", "coagulation", "renal", "cardiovascular", "nervous", total.alias("total"), "bedside", "bedside_last")


@query(
    "score_matrix",
    "WITH " + SC0 + " SELECT stay_id, coagulation + renal + cardiovascular + nervous AS total, bedside FROM st LEFT JOIN so USING (stay_id)",
)
def score_matrix(spark, sf_dir):
    """The two totals beside the cohort."""
    return stays(spark, sf_dir).select("stay_id").join(scores_t0(spark, sf_dir).select("stay_id", "total", "bedside"), "stay_id", "left")


@query(
    "score_distribution",
    "WITH " + SC0 + """ SELECT label, count(*) AS n, round(avg(coagulation + renal + cardiovascular + nervous), 6) AS mean_total, median(coagulation + renal + cardiovascular + nervous)::DOUBLE AS median_total,
 round(avg((plt IS NULL)::INT), 6) AS missing_plt, round(avg((gcs IS NULL)::INT), 6) AS missing_gcs FROM st JOIN so USING (stay_id) GROUP BY 1""",
)
def score_distribution(spark, sf_dir):
    """Distribution of the score by arm and missing shares."""
    total = F.col("coagulation") + F.col("renal") + F.col("cardiovascular") + F.col("nervous")
    rows = _scores(spark, sf_dir).join(stays(spark, sf_dir).select("stay_id", "label"), "stay_id")
    missing = lambda c: r6(F.avg(F.col(c).isNull().cast("int")))
    rows = pinned(rows.withColumn("sum", total))
    found = rows.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("sum")).alias("mean_total"), missing("plt").alias("missing_plt"), missing("gcs").alias("missing_gcs"))
    medians = group_quantiles(rows, ["label"], "sum", {"median_total": 0.5})
    return found.join(medians.select("label", "median_total").hint("merge"), "label")


@query(
    "score_auroc",
    "WITH " + SC0 + """, r AS (SELECT label, unnest([{'score': 'total', 'v': coagulation + renal + cardiovascular + nervous}, {'score': 'bedside', 'v': bedside}, {'score': 'bedside_last', 'v': bedside_last}], recursive := true) FROM st JOIN so USING (stay_id))
SELECT score, round(avg(CASE WHEN p.v > n.v THEN 1.0 WHEN p.v = n.v THEN 0.5 ELSE 0 END), 6) AS auroc FROM (SELECT * FROM r WHERE label = 1) p JOIN (SELECT * FROM r WHERE label = 0) n USING (score) GROUP BY 1""",
)
def score_auroc(spark, sf_dir):
    """Discrimination of the raw scores over the whole cohort."""
    rows = scores_t0(spark, sf_dir).join(stays(spark, sf_dir).select("stay_id", "label"), "stay_id")
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).alias("prob")) for c in ("total", "bedside", "bedside_last")])).alias("s")
    found = auroc(rows.select(F.col("label").alias("y"), named).select("y", "s.*"), ["score"])
    return found.select("score", r6("auroc").alias("auroc"))


@query(
    "score_cohort",
    "WITH " + SC0 + """, o AS (SELECT o_custkey AS stay_id, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT stay_id, label, coagulation + renal + cardiovascular + nervous AS total, bedside, n_orders, c_mktsegment AS segment FROM st JOIN so USING (stay_id) JOIN o USING (stay_id) JOIN customer ON c_custkey = stay_id""",
)
def score_cohort(spark, sf_dir):
    """Scores, cohort, static columns and demographics joined one to one."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("stay_id")).agg(F.count("*").alias("n_orders"))
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("stay_id"), F.col("c_mktsegment").alias("segment"))
    scores = scores_t0(spark, sf_dir).select("stay_id", "total", "bedside")
    return joined_once([stays(spark, sf_dir).select("stay_id", "label"), scores, orders, people], "stay_id")


@query(
    "filled_subjects",
    """SELECT o.o_orderkey AS stay_id, o.o_orderdate AS onset, coalesce(CASE WHEN o.o_orderkey % 4 <> 0 THEN o.o_custkey END, d.s) AS subject_id, d.total
FROM orders o LEFT JOIN (SELECT o_orderkey AS k, o_custkey + 1000000 AS s, o_totalprice AS total FROM orders WHERE o_orderkey % 3 <> 0) d ON d.k = o.o_orderkey""",
)
def filled_subjects(spark, sf_dir):
    """Onsets beside demographics; the subject is the onset's own where known, else the demographics'."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    own = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("subject_id")
    onsets = orders.select(F.col("o_orderkey").alias("stay_id"), F.col("o_orderdate").alias("onset"), own)
    demog = orders.where("o_orderkey % 3 <> 0").select(
        F.col("o_orderkey").alias("stay_id"), (F.col("o_custkey") + 1000000).alias("subject_id"), F.col("o_totalprice").alias("total")
    )
    return filled_join(onsets, demog, "stay_id")


@query(
    "exposure_summary",
    "WITH " + IV + """, ex AS (SELECT stay_id, min(observed_start) AS first FROM iw WHERE concept = 'signup' GROUP BY 1)
, r AS (SELECT stay_id % 3 AS split, label, ex.first IS NOT NULL AS exposed, (ex.first - t0) / 3600 AS h, CASE WHEN label = 1 THEN (outtime - ex.first) / 3600 END AS o FROM st LEFT JOIN ex USING (stay_id))
SELECT split, label, count(*) AS n, count(*) FILTER (exposed) AS n_exposed, round(100.0 * count(*) FILTER (exposed) / count(*), 6) AS percent_exposed, round(quantile_cont(h, 0.5), 6) AS median_h,
 round(quantile_cont(h, 0.25), 6) AS p25_h, round(quantile_cont(h, 0.75), 6) AS p75_h, round(quantile_cont(o, 0.5), 6) AS median_to_onset_h FROM r GROUP BY GROUPING SETS ((split, label), (label))""",
)
def exposure_summary(spark, sf_dir):
    """Exposure by split and arm with the total over splits, and its timing."""
    first = _intervals(spark, sf_dir).where("concept = 'signup'").groupBy("stay_id").agg(F.min("observed_start").alias("first"))
    onset = F.when(F.col("label") == 1, (F.col("outtime") - F.col("first")) / 3600)  # of positives, whose onset ends the stay
    rows = stays(spark, sf_dir).join(first, "stay_id", "left").withColumns({"h": (F.col("first") - F.col("t0")) / 3600, "o": onset})
    # Each row in its split and in the total over splits.
    rows = pinned(rows.select("label", "first", "h", "o", F.explode(F.array(F.col("stay_id") % 3, F.lit(None).cast("long"))).alias("split")))
    n_exposed, keys = F.count("first"), ["split", "label"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), n_exposed.alias("n_exposed"), r6(100.0 * n_exposed / F.count("*")).alias("percent_exposed"))
    times = group_quantiles(rows, keys, "h", {"median_h": 0.5, "p25_h": 0.25, "p75_h": 0.75}).drop("n")
    onsets = group_quantiles(rows, keys, "o", {"median_to_onset_h": 0.5}).drop("n")
    for found in (times, onsets):
        found = found.select(F.col("split").alias("s"), F.col("label").alias("l"), *[r6(c).alias(c) for c in found.columns if c not in keys])
        counts = counts.join(found.hint("merge"), F.col("split").eqNullSafe(F.col("s")) & (F.col("label") == F.col("l"))).drop("s", "l")
    return counts


SK = WIN + """, tr AS (SELECT stay_id FROM st WHERE stay_id % 3 <> 0), c AS (SELECT unnest(['click', 'view']) AS concept)
, hw AS (SELECT *, (23 - least(greatest(floor(hours_before), 0), 23))::INT AS t FROM win)
, sk AS (SELECT stay_id, concept, unnest(range(24))::INT AS t FROM st, c)"""


def _grid_inputs(spark, sf_dir):
    cohort = stays(spark, sf_dir)
    concepts = spark.range(2).select(F.element_at(F.array(F.lit("click"), F.lit("view")), (F.col("id") + 1).cast("int")).alias("concept"))
    rows = _window(spark, sf_dir).where(F.col("concept").isin("click", "view"))
    return rows, cohort, concepts, cohort.where("stay_id % 3 <> 0")


@query(
    "grid_point",
    "WITH " + SK + """, sc AS (SELECT concept, avg(value) AS mu, CASE WHEN stddev_pop(value) < 1e-8 THEN 1 ELSE stddev_pop(value) END AS sd FROM win SEMI JOIN tr USING (stay_id) GROUP BY 1)
, h AS (SELECT stay_id, concept, t, avg(value) AS v FROM hw GROUP BY 1, 2, 3)
, f AS (SELECT sk.*, v, mu, sd, last_value(v IGNORE NULLS) OVER w AS carried, max(CASE WHEN v IS NOT NULL THEN t END) OVER w AS seen FROM sk LEFT JOIN h USING (stay_id, concept, t) LEFT JOIN sc USING (concept)
  WINDOW w AS (PARTITION BY stay_id, concept ORDER BY t ROWS UNBOUNDED PRECEDING))
SELECT stay_id, concept, t, round((coalesce(carried, mu) - mu) / sd, 6) AS value, (v IS NOT NULL)::INT AS mask, round(least(coalesce(t - seen, 24), 24) / 24.0, 6) AS delta FROM f""",
)
def grid_point(spark, sf_dir):
    """Point-in-time concepts on the hourly grid."""
    grid = X.grid_point(*_grid_inputs(spark, sf_dir))
    return grid.withColumns({"value": r6("value"), "delta": r6("delta")})


@query(
    "grid_cumulative",
    "WITH " + SK + """, h AS (SELECT stay_id, concept, t, sum(value) AS v FROM hw GROUP BY 1, 2, 3)
, f AS (SELECT sk.*, v, ln(1 + greatest(coalesce(v, 0), 0)) AS x, max(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY stay_id, concept ORDER BY t ROWS UNBOUNDED PRECEDING) AS seen FROM sk LEFT JOIN h USING (stay_id, concept, t))
, sc AS (SELECT concept, avg(x) AS mu, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS sd FROM f SEMI JOIN tr USING (stay_id) GROUP BY 1)
SELECT stay_id, concept, t, round((x - mu) / sd, 6) AS value, (v IS NOT NULL)::INT AS mask, round(least(coalesce(t - seen, 24), 24) / 24.0, 6) AS delta FROM f JOIN sc USING (concept)""",
)
def grid_cumulative(spark, sf_dir):
    """Cumulative concepts on the hourly grid."""
    grid = X.grid_cumulative(*_grid_inputs(spark, sf_dir))
    return grid.withColumns({"value": r6("value"), "delta": r6("delta")})


@query(
    "grid_invariants",
    "WITH " + SK + """ SELECT count(*) FILTER (t = 3 AND stay_id % 7 = 0) AS bad_value, count(*) FILTER (t = 5 AND stay_id % 5 = 0) AS bad_mask,
 count(*) FILTER (t = 6 AND stay_id % 3 = 0) AS bad_delta, (SELECT count(*) FROM sk WHERE t = 8 AND stay_id % 11 = 0) AS bad_bins FROM sk WHERE NOT (t = 8 AND stay_id % 11 = 0)""",
)
def grid_invariants(spark, sf_dir):
    """Rows of a grid of both classes that break the grid's rules (some are made to)."""
    rows, cohort, concepts, train = _grid_inputs(spark, sf_dir)
    one, two = (F.col("concept") == c for c in ("click", "view"))
    grid = X.grid_point(rows.where(one), cohort, concepts.where(one), train).unionByName(X.grid_cumulative(rows.where(two), cohort, concepts.where(two), train))
    at = lambda t, k: (F.col("t") == t) & (F.col("stay_id") % k == 0)
    broken = {
        "value": F.when(~at(3, 7), F.col("value")), "mask": F.when(at(5, 5), 2).otherwise(F.col("mask")),
        "delta": F.when(at(6, 3), 1.5).otherwise(F.col("delta")),
    }
    return X.grid_faults(grid.where(~at(8, 11)).withColumns(broken))


@query(
    "feature_slices",
    "WITH " + EV + """, c AS (SELECT concept, row_number() OVER (ORDER BY concept) - 1 AS i FROM (SELECT DISTINCT concept FROM ev))
SELECT 'series' AS modality, concept AS unit, 3 * i AS first, 3 * i + 2 AS last FROM c UNION ALL SELECT 'static', 'age', 0, 0 UNION ALL SELECT 'static', 'sex', 1, 1""",
)
def feature_slices(spark, sf_dir):
    """The columns of each unit of a packed bundle: three channels of a concept, or one static column."""
    concepts = [r["concept"] for r in points(spark, sf_dir).select("concept").distinct().orderBy("concept").collect()]  # the concept list
    return X.feature_slices(spark, {"series": concepts}, ["age", "sex"])


BUNDLE = """, co AS (SELECT stay_id, label FROM st WHERE stay_id % 5 <> 4), tr AS (SELECT stay_id FROM co WHERE stay_id % 3 <> 0)
, md AS (SELECT unnest([{'modality': 'vitals', 'concept': 'view', 'cum': false}, {'modality': 'vitals', 'concept': 'click', 'cum': false}, {'modality': 'treatments', 'concept': 'error', 'cum': false}, {'modality': 'treatments', 'concept': 'purchase', 'cum': true}, {'modality': 'treatments', 'concept': 'unseen', 'cum': false}], recursive := true))
, e AS (SELECT stay_id, concept, cum, value, (23 - least(greatest(floor(hours_before), 0), 23))::INT AS t FROM win JOIN md USING (concept) SEMI JOIN co USING (stay_id))
, h AS (SELECT stay_id, concept, t, CASE WHEN cum THEN sum(value) ELSE avg(value) END AS v FROM e GROUP BY 1, 2, 3, cum)
, sk AS (SELECT stay_id, label, modality, concept, cum, unnest(range(24))::INT AS t FROM co, md)
, f AS (SELECT sk.*, v, ln(1 + greatest(coalesce(v, 0), 0)) AS x, last_value(v IGNORE NULLS) OVER w AS carried, max(CASE WHEN v IS NOT NULL THEN t END) OVER w AS seen FROM sk LEFT JOIN h USING (stay_id, concept, t)
  WINDOW w AS (PARTITION BY stay_id, concept ORDER BY t ROWS UNBOUNDED PRECEDING))
, sc AS (SELECT concept, avg(value) AS mu, stddev_pop(value) AS sd FROM e SEMI JOIN tr USING (stay_id) WHERE NOT cum GROUP BY 1
  UNION ALL SELECT concept, avg(x), stddev_pop(x) FROM f SEMI JOIN tr USING (stay_id) WHERE cum GROUP BY 1)
, sb AS (SELECT stay_id, label, unnest([{'unit': 'balance', 'v': c_acctbal::DOUBLE}, {'unit': 'nation', 'v': (CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey END)::DOUBLE}], recursive := true) FROM co LEFT JOIN customer ON c_custkey = stay_id)
, ss AS (SELECT unit, avg(v) AS mu, stddev_pop(v) AS sd FROM sb SEMI JOIN tr USING (stay_id) GROUP BY 1)
SELECT stay_id, label, modality, concept AS unit, t, round(coalesce((CASE WHEN cum THEN x ELSE coalesce(carried, mu) END - mu) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END, 0), 6) + 0.0 AS value,
  (v IS NOT NULL)::INT AS mask, round(least(coalesce(t - seen, 24), 24) / 24.0, 6) AS delta FROM f LEFT JOIN sc USING (concept)
UNION ALL SELECT stay_id, label, 'static', unit, NULL, round((coalesce(v, mu) - mu) / sd, 6) + 0.0, NULL, NULL FROM sb JOIN ss USING (unit)"""


def _bundle_modalities(spark, sf_dir):
    rows = _window(spark, sf_dir)
    return {"vitals": B.Modality(rows, ("view", "click")), "treatments": B.Modality(rows, ("error", "purchase", "unseen"), frozenset(["purchase"]))}


@query("grid_bundle", "WITH " + WIN + BUNDLE)
def grid_bundle(spark, sf_dir):
    """Series, static block and labels of a subset of the cohort, with statistics of training stays; every value."""
    cohort, modalities = stays(spark, sf_dir), _bundle_modalities(spark, sf_dir)
    people = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey")).alias("nation")
    static = people.select(F.col("c_custkey").alias("stay_id"), F.col("c_acctbal").cast("double").alias("balance"), nation, F.lit(1).alias("same"))
    bundle = B.grid_bundle(cohort, modalities, static, cohort.where("stay_id % 3 <> 0"), cohort.where("stay_id % 5 <> 4"))
    cells = B.bundle_cells(bundle, modalities)
    return cells.withColumns({"value": r6("value") + 0.0, "delta": r6("delta")})


@query(
    "grid_units",
    "WITH " + SK + " SELECT stay_id, count(DISTINCT t)::INT AS hours, (3 * count(DISTINCT concept))::INT AS width FROM sk GROUP BY 1",
)
def grid_units(spark, sf_dir):
    """The packed tensor of a stay, its hours and its width of three channels per concept."""
    tensor = X.packed_grid(X.grid_point(*_grid_inputs(spark, sf_dir)), ["click", "view"])
    return tensor.select("stay_id", F.size("tensor").alias("hours"), F.array_max(F.transform("tensor", lambda h: F.size(h))).alias("width"))
