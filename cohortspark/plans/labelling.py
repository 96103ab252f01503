"""Queries of the labelling stage: as-of joins, suspicion, grids, trailing windows, controls, splits, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import clinical
from cohortspark.functions.columns import hash_uniform
from cohortspark.operators import cohort as C
from cohortspark.operators import gates as G
from cohortspark.operators import timeops as T
from cohortspark.operators.evaluation import mean_difference
from cohortspark.plans.inputs import EV, ST, intervals, points, r6, stays, table
from cohortspark.plans.registry import query

ABX = EV + """, abx AS (SELECT event_id, stay_id, charttime AS t FROM ev WHERE concept = 'purchase')
, cul AS (SELECT stay_id, charttime AS t FROM ev WHERE concept = 'error')"""
PAIRS = ABX + """, near AS (SELECT a.*, (SELECT min(c.t) FROM cul c WHERE c.stay_id = a.stay_id AND c.t >= a.t) AS nxt,
  (SELECT max(c.t) FROM cul c WHERE c.stay_id = a.stay_id AND c.t <= a.t) AS prv FROM abx a)
, p AS (SELECT stay_id, t, CASE WHEN nxt - t <= 86400 THEN nxt WHEN t - prv <= 259200 THEN prv END AS culture_time,
  CASE WHEN nxt - t <= 86400 THEN t WHEN t - prv <= 259200 THEN prv END AS suspicion_time FROM near)
, s AS (SELECT stay_id, arg_min(suspicion_time, (t, culture_time)) AS suspicion_time, min(t) AS antibiotic_time,
  arg_min(culture_time, (t, culture_time)) AS culture_time FROM p WHERE culture_time IS NOT NULL GROUP BY 1)"""


def _abx(spark, sf_dir):
    p = points(spark, sf_dir)
    abx = p.where("concept = 'purchase'").select("event_id", "stay_id", F.col("charttime").alias("abx_time"))
    return abx, p.where("concept = 'error'").select("stay_id", F.col("charttime").alias("culture_time"))


@query("asof_both", "WITH " + PAIRS + " SELECT event_id, stay_id, t AS abx_time, nxt AS next_time, prv AS previous_time FROM near")
def asof_both(spark, sf_dir):
    """Nearest culture after and before each antibiotic, exact times allowed."""
    abx, cultures = _abx(spark, sf_dir)
    return T.asof(abx, cultures, "stay_id", "abx_time", "culture_time")


@query("suspicion", "WITH " + PAIRS + " SELECT * FROM s")
def suspicion(spark, sf_dir):
    """Earliest antibiotic that pairs with a culture."""
    abx, cultures = _abx(spark, sf_dir)
    return C.suspicion(abx, cultures)


@query(
    "suspicion_legacy",
    "WITH " + PAIRS + " SELECT stay_id, suspicion_time AS onset_time, suspicion_time - 21600 AS prediction_time, 1 AS label FROM s",
)
def suspicion_legacy(spark, sf_dir):
    """The older output of the same rule."""
    abx, cultures = _abx(spark, sf_dir)
    return C.suspicion_with_prediction(abx, cultures, 6)


GRID = ST + """, b AS (SELECT stay_id, greatest(t0 - 172800, intime) AS grid_start, least(t0 + 86400, outtime) AS grid_end FROM st)
, gr AS (SELECT stay_id, grid_start, k, grid_start + k * 3600.0 AS grid_time FROM (
    SELECT *, unnest(range(ceil((grid_end + 1 - grid_start) / 3600.0)::BIGINT))::INT AS k FROM b))"""


def _grid(spark, sf_dir):
    s = stays(spark, sf_dir)
    bounds = s.select("stay_id", F.greatest(F.col("t0") - 172800, "intime").alias("grid_start"), F.least(F.col("t0") + 86400, "outtime").alias("grid_end"))
    return T.hour_grid(bounds).select("stay_id", "grid_start", "k", "grid_time")


@query("hour_grid", "WITH " + GRID + " SELECT stay_id, k, grid_time FROM gr")
def hour_grid(spark, sf_dir):
    """hourly points around the prediction."""
    return _grid(spark, sf_dir).select("stay_id", "k", "grid_time")


@query(
    "trailing_worst",
    "WITH " + GRID + """
SELECT gr.stay_id, gr.k, min(ev.value) AS window_min, max(ev.value) AS window_max, round(coalesce(sum(ev.value), 0), 6) AS window_sum, count(ev.value) AS window_count
FROM gr LEFT JOIN ev ON ev.stay_id = gr.stay_id AND ev.concept = 'view' AND ev.charttime > gr.grid_time - 86400 AND ev.charttime <= gr.grid_time GROUP BY 1, 2
""",
)
def trailing_worst(spark, sf_dir):
    """Minimum, maximum, sum and count over the trailing day of each grid hour."""
    rolled = T.trailing(points(spark, sf_dir).where("concept = 'view'"), _grid(spark, sf_dir))
    return rolled.withColumn("window_sum", r6("window_sum"))


@query(
    "vaso_trailing",
    "WITH " + GRID + """, va AS (SELECT stay_id, charttime AS s, charttime + value * 60 AS e, value / 1000 AS rate FROM ev WHERE concept = 'purchase')
SELECT gr.stay_id, gr.k, max(rate) AS window_rate FROM gr LEFT JOIN va ON va.stay_id = gr.stay_id AND va.s <= gr.grid_time AND va.e >= gr.grid_time - 86400 GROUP BY 1, 2
""",
)
def vaso_trailing(spark, sf_dir):
    """Largest rate of intervals active in the trailing day."""
    rows = intervals(spark, sf_dir).where("concept = 'purchase'").withColumn("rate", F.col("amount") / 1000)
    return T.trailing_interval_max(rows, _grid(spark, sf_dir))


PARTS = ["respiration", "coagulation", "liver", "cardiovascular", "nervous", "renal"]


def _scored(spark, sf_dir):
    p, grid = points(spark, sf_dir), _grid(spark, sf_dir)
    of = lambda c, v=F.col("value"): F.when(F.col("concept") == c, v)
    worst = {
        "pao2": (of("click", 150 + F.col("value")), "min"),
        "fio2": (of("view", 21 + F.col("value") % 40), "max"),
        "spo2": (of("error", 80 + F.col("value") % 20), "min"),
        "vent": (of("purchase", F.col("event_id") % 2), "max"),
        "plt": (of("click"), "min"),
        "bili": (of("signup", F.col("value") / 200), "max"),
        "map": (of("view", F.col("value") / 4), "min"),
        "gcs": (of("error", (3 + F.col("event_id") % 13).cast("double")), "min"),
        "cre": (of("signup", F.col("value") / 60), "max"),
        "uo": (of("view", 10 * F.col("value")), "sum"),
        "uo_n": (of("view"), "count"),
    }
    support = intervals(spark, sf_dir).where("concept = 'purchase' and event_id % 3 = 0").withColumn("rate", F.col("amount") / 4000)
    vaso = T.trailing_interval_max(support, grid).withColumnRenamed("window_rate", "vaso")
    scored = T.trailing_worst(p, grid, worst).join(vaso.hint("merge"), ["stay_id", "k"])
    c = F.col
    parts = {
        "respiration": clinical.respiration(c("pao2"), c("fio2"), c("spo2"), c("vent") == 1),
        "coagulation": clinical.coagulation(c("plt")),
        "liver": clinical.liver(c("bili")),
        "cardiovascular": clinical.cardiovascular(c("map"), c("vaso")),
        "nervous": clinical.nervous(c("gcs")),
        "renal": clinical.renal(c("cre"), c("uo"), c("uo_n")),
    }
    return scored.withColumns(parts).withColumn("total", sum((c(x) for x in PARTS[1:]), c(PARTS[0])))


SUM = " + ".join(PARTS)
SCORED = GRID + f""", w1 AS (SELECT gr.stay_id, gr.k, gr.grid_time,
  min(CASE WHEN concept = 'click' THEN 150 + value END) AS pao2, max(CASE WHEN concept = 'view' THEN 21 + value % 40 END) AS fio2,
  min(CASE WHEN concept = 'error' THEN 80 + value % 20 END) AS spo2, max(CASE WHEN concept = 'purchase' THEN event_id % 2 END) AS vent,
  min(CASE WHEN concept = 'click' THEN value END) AS plt, max(CASE WHEN concept = 'signup' THEN value / 200 END) AS bili,
  min(CASE WHEN concept = 'view' THEN value / 4 END) AS map, min(CASE WHEN concept = 'error' THEN 3 + event_id % 13 END) AS gcs,
  max(CASE WHEN concept = 'signup' THEN value / 60 END) AS cre, coalesce(sum(CASE WHEN concept = 'view' THEN 10 * value END), 0) AS uo, count(CASE WHEN concept = 'view' THEN value END) AS uo_n
  FROM gr LEFT JOIN ev ON ev.stay_id = gr.stay_id AND ev.charttime > gr.grid_time - 86400 AND ev.charttime <= gr.grid_time GROUP BY 1, 2, 3)
, va AS (SELECT stay_id, charttime AS s, charttime + value * 60 AS e, value / 4000 AS rate FROM ev WHERE concept = 'purchase' AND event_id % 3 = 0)
, w2 AS (SELECT gr.stay_id, gr.k, max(rate) AS vaso FROM gr LEFT JOIN va ON va.stay_id = gr.stay_id AND va.s <= gr.grid_time AND va.e >= gr.grid_time - 86400 GROUP BY 1, 2)
, w AS (SELECT *, pao2 / (fio2 / 100) AS r, least(spo2, 97) / (fio2 / 100) AS s FROM w1 JOIN w2 USING (stay_id, k))
, sc AS (SELECT *, CASE WHEN r IS NOT NULL THEN CASE WHEN r < 100 AND vent = 1 THEN 4 WHEN r < 200 AND vent = 1 THEN 3 WHEN r < 300 THEN 2 WHEN r < 400 THEN 1 ELSE 0 END
   WHEN spo2 IS NOT NULL AND fio2 IS NOT NULL THEN CASE WHEN s <= 67 THEN 4 WHEN s <= 142 THEN 3 WHEN s <= 221 THEN 2 WHEN s <= 302 THEN 1 ELSE 0 END ELSE 0 END AS respiration,
  CASE WHEN plt < 20 THEN 4 WHEN plt < 50 THEN 3 WHEN plt < 100 THEN 2 WHEN plt < 150 THEN 1 ELSE 0 END AS coagulation,
  CASE WHEN bili >= 12 THEN 4 WHEN bili >= 6 THEN 3 WHEN bili >= 2 THEN 2 WHEN bili >= 1.2 THEN 1 ELSE 0 END AS liver,
  CASE WHEN vaso > 0.1 THEN 4 WHEN vaso > 0 THEN 3 WHEN map < 70 THEN 1 ELSE 0 END AS cardiovascular,
  CASE WHEN gcs < 6 THEN 4 WHEN gcs < 10 THEN 3 WHEN gcs < 13 THEN 2 WHEN gcs < 15 THEN 1 ELSE 0 END AS nervous,
  greatest(CASE WHEN cre >= 5 THEN 4 WHEN cre >= 3.5 THEN 3 WHEN cre >= 2 THEN 2 WHEN cre >= 1.2 THEN 1 ELSE 0 END, CASE WHEN uo_n > 0 AND uo < 200 THEN 4 WHEN uo_n > 0 AND uo < 500 THEN 3 ELSE 0 END) AS renal FROM w)
, hit AS (SELECT stay_id, min(k) AS k FROM sc WHERE {SUM} >= 6 GROUP BY 1)
, fh AS (SELECT stay_id, k, grid_time, {SUM} AS total, {", ".join(PARTS)} FROM sc JOIN hit USING (stay_id, k))"""


def _first_hit(spark, sf_dir):
    return T.first_hit(_scored(spark, sf_dir), "total", 6, PARTS)


@query("first_hit", "WITH " + SCORED + " SELECT * FROM fh")
def first_hit(spark, sf_dir):
    """First grid hour whose score of six organs reaches the threshold."""
    return _first_hit(spark, sf_dir)


LABELLED = SCORED + """, abx AS (SELECT event_id, stay_id, charttime AS t FROM ev WHERE concept = 'purchase')
, cul AS (SELECT stay_id, charttime AS t FROM ev WHERE concept = 'error')""" + PAIRS[len(ABX):] + """
, joined AS (SELECT st.stay_id, intime, outtime, s.suspicion_time, fh.grid_time AS onset_time, fh.grid_time - 21600 AS prediction_time, fh.total
  FROM st LEFT JOIN s USING (stay_id) LEFT JOIN fh USING (stay_id) WHERE outtime - intime >= 86400)
, status AS (SELECT *, CASE WHEN suspicion_time IS NULL THEN 'no suspicion' WHEN onset_time IS NULL THEN 'no score'
   WHEN prediction_time >= intime AND prediction_time <= outtime THEN 'positive' ELSE 'outside stay' END AS status FROM joined)"""


def _status(spark, sf_dir):
    abx, cultures = _abx(spark, sf_dir)
    eligible = stays(spark, sf_dir).where("outtime - intime >= 86400").select("stay_id", "intime", "outtime")
    rows = eligible.join(C.suspicion(abx, cultures).select("stay_id", "suspicion_time"), "stay_id", "left")
    hits = _first_hit(spark, sf_dir).select("stay_id", F.col("grid_time").alias("onset_time"), "total")
    rows = rows.join(hits.hint("merge"), "stay_id", "left").withColumn("prediction_time", F.col("onset_time") - 21600)
    inside = F.col("prediction_time").between(F.col("intime"), F.col("outtime"))
    status = F.when(F.col("suspicion_time").isNull(), "no suspicion").when(F.col("onset_time").isNull(), "no score")
    return rows.withColumn("status", status.when(inside, "positive").otherwise("outside stay"))


@query("labelled_cohort", "WITH " + LABELLED + " SELECT stay_id, onset_time, prediction_time, total, status FROM status")
def labelled_cohort(spark, sf_dir):
    """Eligibility, suspicion, first hit, then the stay filter, in this order."""
    return _status(spark, sf_dir).select("stay_id", "onset_time", "prediction_time", "total", "status")


@query(
    "cohort_counters",
    "WITH " + LABELLED + """ SELECT count(*) AS eligible, count(suspicion_time) AS suspected, count(*) FILTER (status = 'no score') AS no_score,
  count(*) FILTER (status = 'outside stay') AS outside_stay, count(*) FILTER (status = 'positive') AS positives FROM status""",
)
def cohort_counters(spark, sf_dir):
    """Counts of the outcomes of cohort building."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return _status(spark, sf_dir).agg(
        F.count("*").alias("eligible"), F.count("suspicion_time").alias("suspected"), is_("no score").alias("no_score"),
        is_("outside stay").alias("outside_stay"), is_("positive").alias("positives"),
    )


@query(
    "control_composition",
    "WITH " + LABELLED + """ SELECT count(*) AS controls, count(suspicion_time) AS with_suspicion,
  count(*) FILTER (suspicion_time IS NOT NULL AND onset_time IS NOT NULL) AS full_rule FROM status WHERE status <> 'positive'""",
)
def control_composition(spark, sf_dir):
    """How many controls have a suspicion, or meet the whole rule."""
    rows = _status(spark, sf_dir).where("status <> 'positive'")
    return rows.agg(
        F.count("*").alias("controls"), F.count("suspicion_time").alias("with_suspicion"),
        F.count_if(F.col("suspicion_time").isNotNull() & F.col("onset_time").isNotNull()).alias("full_rule"),
    )


LEAD = 1000.0


def _rank_sql(name: str, needs: str, pool: str) -> str:
    """CTEs that match needs (id, v) with a pool (id, v, cap) by rank: <name>_m has the needs with their match, <name> the pairs."""
    return f""", {name}_n AS (SELECT *, row_number() OVER (ORDER BY v DESC, id) AS i FROM {needs}), {name}_h AS (SELECT *, row_number() OVER (ORDER BY v DESC, id) AS c FROM {pool})
, {name}_c AS (SELECT *, (SELECT count(*) FROM {pool} h WHERE h.v >= n.v) AS c FROM {name}_n n)
, {name}_r AS (SELECT *, i + least(0, min(c - i) OVER (ORDER BY i)) AS m, i - 1 + least(0, coalesce(min(c - i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS pm FROM {name}_c)
, {name}_m AS (SELECT *, c - m + 1 AS free FROM {name}_r WHERE m > pm)
, {name} AS (SELECT m.id, h.id AS control_id, h.cap AS capacity FROM {name}_m m JOIN {name}_h h ON h.c = m.m)"""


MATCH = (
    """n AS (SELECT o_orderkey AS id, 0.5 * o_totalprice AS offset_v, 0.5 * o_totalprice + 1000 AS v FROM orders WHERE o_orderpriority = '1-URGENT')
, h AS (SELECT o_orderkey AS id, o_totalprice::DOUBLE AS v, o_totalprice AS cap FROM orders WHERE o_orderpriority <> '1-URGENT')"""
    + _rank_sql("w", "n", "h")
    + """, lg AS (SELECT v, id, CASE WHEN free > 1 THEN ln(1 - 1.0::DOUBLE / free) ELSE -40.0 END AS x FROM w_m)
, cum AS (SELECT v, x, sum(x) OVER (ORDER BY v, id ROWS UNBOUNDED PRECEDING) AS s FROM lg)
, lv AS (SELECT h.*, coalesce(s, 0) - ln(('0x' || substr(md5('0:' || h.id), 1, 8))::BIGINT / 4294967296.0::DOUBLE + 0.5::DOUBLE / 4294967296.0) AS y
   FROM h ASOF LEFT JOIN (SELECT v, min(s) AS s FROM cum GROUP BY v) c ON h.v >= c.v)
, dr AS (SELECT lv.id, lv.v, lv.cap, least(lv.v, m.v) AS turn, m.v IS NOT NULL AS drawn FROM lv ASOF LEFT JOIN (SELECT s - x AS z, v FROM cum) m ON lv.y <= m.z)
, d1 AS (SELECT id, turn AS v, cap FROM dr WHERE drawn)"""
    + _rank_sql("a", "n", "d1")
    + """, n2 AS (SELECT * FROM n ANTI JOIN a USING (id)), d2 AS (SELECT id, v, cap FROM dr ANTI JOIN (SELECT control_id AS id FROM a) USING (id))"""
    + _rank_sql("b", "n2", "d2")
    + """, mt AS (SELECT n.id AS positive_id, n.offset_v, p.control_id, p.capacity FROM n LEFT JOIN (SELECT * FROM a UNION ALL SELECT * FROM b) p USING (id))"""
)


def _matched(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    offsets = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("positive_id"), (0.5 * F.col("o_totalprice")).alias("offset"))
    pool = o.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("control_id"), F.col("o_totalprice").alias("capacity"))
    return C.match_controls(offsets, pool, LEAD)


@query("match_controls", "WITH " + MATCH + " SELECT positive_id, 0::BIGINT AS copy, offset_v AS \"offset\", control_id, capacity FROM mt")
def match_controls(spark, sf_dir):
    """Controls drawn for the offsets without replacement, as many as possible."""
    return _matched(spark, sf_dir)


@query(
    "match_counts",
    "WITH " + MATCH + " SELECT count(*) AS requested, count(control_id) AS matched, count(*) FILTER (control_id IS NULL) AS unmatched, count(*) FILTER (capacity < offset_v + 1000) AS tail_violations, round((avg(offset_v) - avg(offset_v) FILTER (control_id IS NOT NULL)) / sqrt((var_pop(offset_v) + var_pop(offset_v) FILTER (control_id IS NOT NULL)) / 2), 6) AS smd FROM mt",
)
def match_counts(spark, sf_dir):
    """Report on the matching."""
    return G.matching_report(_matched(spark, sf_dir), LEAD).withColumn("smd", r6("smd"))


@query(
    "controls_legacy",
    "WITH " + ST + """, pos AS (SELECT t0 - intime AS o, row_number() OVER (ORDER BY t0 - intime) - 1 AS slot FROM st WHERE label = 1)
, ch AS (SELECT *, floor(('0x' || substr(md5('4:' || stay_id), 1, 8))::BIGINT / 4294967296.0 * (SELECT count(*) FROM pos)) AS slot FROM st WHERE label = 0
   ORDER BY md5('3:' || stay_id), stay_id LIMIT (SELECT count(*) FROM pos))
SELECT stay_id, least(intime + o, outtime) AS prediction_time FROM ch JOIN pos USING (slot)""",
)
def controls_legacy(spark, sf_dir):
    """The older control draw, kept as a labelled mode."""
    s = stays(spark, sf_dir)
    offsets = s.where("label = 1").select((F.col("t0") - F.col("intime")).alias("offset"))
    return C.random_controls(s.where("label = 0"), offsets, 1, 3).select("stay_id", "prediction_time")


SPLIT = EV + """, su AS (SELECT stay_id AS subject_id, max((stay_id % 2)::INT) AS label FROM ev GROUP BY 1)
, rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || subject_id), subject_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM su)
, sp AS (SELECT subject_id, label, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'val' ELSE 'test' END AS split, ((r - 1) % 5)::INT AS fold FROM rk)"""


def _subjects(spark, sf_dir):
    return stays(spark, sf_dir).select("stay_id", F.col("stay_id").alias("subject_id"), "label")


@query("group_split", "WITH " + SPLIT + " SELECT subject_id, label, split FROM sp")
def group_split(spark, sf_dir):
    """Stratified split by subject."""
    return C.assign_splits(_subjects(spark, sf_dir))


@query("grouped_folds", "WITH " + SPLIT + " SELECT subject_id, label, fold FROM sp")
def grouped_folds(spark, sf_dir):
    """Stratified folds by subject."""
    return C.grouped_folds(_subjects(spark, sf_dir))


FALLBACK = """ (SELECT subject_id, label, CASE WHEN outer_fold = 0 THEN 'test' WHEN (row_number() OVER (PARTITION BY label, outer_fold = 0 ORDER BY md5('43:' || subject_id), subject_id) - 1) % 5 = 0 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || subject_id), subject_id) - 1) % 5 AS outer_fold FROM su))"""


@query("fallback_splits", "WITH " + SPLIT + " SELECT * FROM" + FALLBACK)
def fallback_splits(spark, sf_dir):
    """Two rounds of five folds where a cohort has no split."""
    return C.fallback_splits(_subjects(spark, sf_dir))


@query(
    "load_splits",
    "WITH " + SPLIT + " SELECT 'made' AS source, subject_id AS stay_id, split FROM" + FALLBACK
    + " UNION ALL SELECT 'read', o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END FROM orders",
)
def load_splits(spark, sf_dir):
    """Splits of a cohort, read by their spellings or made, checked for leakage and empty ones."""
    made = C.load_splits(_subjects(spark, sf_dir)).withColumn("source", F.lit("made"))
    spelled = F.element_at(F.array(*map(F.lit, ["TR", "validation", "te"])), (F.col("o_custkey") % 3 + 1).cast("int"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("subject_id"), F.lit(0).alias("label"), spelled.alias("split")
    )
    return made.unionByName(C.load_splits(orders.unionByName(orders.limit(5))).withColumn("source", F.lit("read"))).select("source", "stay_id", "split")


@query("split_counts", "WITH " + SPLIT + " SELECT split, label, count(*) AS n FROM sp GROUP BY 1, 2")
def split_counts(spark, sf_dir):
    """Stays per split and label."""
    return C.assign_splits(_subjects(spark, sf_dir)).groupBy("split", "label").agg(F.count("*").alias("n"))


@query("split_names", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders")
def split_names(spark, sf_dir):
    """Spellings of split names (an unknown one is an error)."""
    spelled = F.when(F.col("o_orderstatus") == "F", " Tr").when(F.col("o_orderstatus") == "O", "DEV").otherwise("te ")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.normal_split(spelled).alias("split"))


@query(
    "leakage_gate",
    "SELECT o_custkey AS subject_id, count(DISTINCT o_orderstatus) AS n_splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1",
)
def leakage_gate(spark, sf_dir):
    """Subjects in more than one split."""
    return G.leakage(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderstatus").alias("split")))


@query(
    "gates",
    "WITH " + LABELLED + """, co AS (SELECT stay_id, CASE WHEN status = 'positive' THEN 1 ELSE 0 END AS label, CASE WHEN status = 'positive' THEN onset_time END AS onset_time,
   coalesce(CASE WHEN status = 'positive' THEN prediction_time END, intime + 0.5 * (outtime - intime)) AS prediction_time, suspicion_time, intime, outtime, stay_id % 6 AS a, stay_id % 4 AS b, stay_id % 3 AS c, stay_id % 6 + stay_id % 4 + stay_id % 3 + CASE WHEN stay_id % 50 = 0 THEN 1 ELSE 0 END AS total FROM status)
SELECT gate, n_bad = 0 AS passed, n_bad::BIGINT AS n_bad FROM (
SELECT 'duplicate_stays' AS gate, count(*) - count(DISTINCT stay_id) AS n_bad FROM co
UNION ALL SELECT 'prediction_is_onset_less_lead', count(*) FROM co WHERE label = 1 AND abs(onset_time - 21600 - prediction_time) > 1e-6
UNION ALL SELECT 'prediction_inside_stay', count(*) FROM co WHERE NOT (prediction_time BETWEEN intime AND outtime)
UNION ALL SELECT 'onset_near_suspicion', count(*) FROM co WHERE label = 1 AND NOT (onset_time - suspicion_time BETWEEN -172800 AND 86400)
UNION ALL SELECT 'parts_in_range', count(*) FROM co WHERE greatest(a, b, c) > 4
UNION ALL SELECT 'total_in_range', count(*) FROM co WHERE label = 1 AND NOT total BETWEEN 2 AND 24
UNION ALL SELECT 'total_is_sum', count(*) FROM co WHERE total <> a + b + c
UNION ALL SELECT 'control_at_discharge', count(*) FROM co WHERE label = 0 AND prediction_time = outtime
UNION ALL SELECT 'control_tail_margin', count(*) FROM co WHERE label = 0 AND outtime - prediction_time < 21600
UNION ALL SELECT 'control_has_onset', count(*) FROM co WHERE label = 0 AND onset_time IS NOT NULL
UNION ALL SELECT 'both_arms_present', 2 - count(DISTINCT label) FROM co)""",
)
def gates(spark, sf_dir):
    """All cohort gates in one pass, over rows of which some break them."""
    s = _status(spark, sf_dir)
    positive = F.col("status") == "positive"
    rows = s.select(
        "stay_id", positive.cast("int").alias("label"), F.when(positive, F.col("onset_time")).alias("onset_time"),
        F.coalesce(F.when(positive, F.col("prediction_time")), F.col("intime") + 0.5 * (F.col("outtime") - F.col("intime"))).alias("prediction_time"),
        "suspicion_time", "intime", "outtime", (F.col("stay_id") % 6).alias("part_a"), (F.col("stay_id") % 4).alias("part_b"), (F.col("stay_id") % 3).alias("part_c"),
    ).withColumn("total", F.col("part_a") + F.col("part_b") + F.col("part_c") + F.when(F.col("stay_id") % 50 == 0, 1).otherwise(0))
    return G.gates(rows, G.cohort_checks(21600.0))


@query(
    "smd_balance",
    "WITH " + ST + " SELECT round(m1, 6) AS m1, round(m0, 6) AS m0, round((m1 - m0) / sqrt((v1 + v0) / 2), 6) AS smd FROM (SELECT avg(t0 - intime) FILTER (label = 1) AS m1, avg(t0 - intime) FILTER (label = 0) AS m0, var_pop(t0 - intime) FILTER (label = 1) AS v1, var_pop(t0 - intime) FILTER (label = 0) AS v0 FROM st)",
)
def smd_balance(spark, sf_dir):
    """Standardised mean difference of the arms' offsets."""
    rows = stays(spark, sf_dir).withColumn("offset_s", F.col("t0") - F.col("intime"))
    return mean_difference(rows, "label", "offset_s").select(*[r6(c).alias(c) for c in ("m1", "m0", "smd")])


@query(
    "balanced_subset",
    "WITH " + ST + " SELECT stay_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('5:' || stay_id), stay_id) AS r FROM st) WHERE r <= 20",
)
def balanced_subset(spark, sf_dir):
    """The first rows of each label in hash order (the limit is the operator)."""
    return C.balanced_subset(stays(spark, sf_dir), 20, 5).select("stay_id", "label")


@query("hash_numbers", "SELECT doc_id, ('0x' || substr(md5('9:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents")
def hash_numbers(spark, sf_dir):
    """The reproducible random numbers behind every draw."""
    return table(spark, sf_dir, "documents").select("doc_id", hash_uniform(9, F.col("doc_id")).alias("u"))
