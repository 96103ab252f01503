"""Queries of sources and sinks, whole extraction jobs and the clean-up of cohorts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortspark.functions import clinical
from cohortspark.operators import cohort as C
from cohortspark.operators import gates as G
from cohortspark.operators.timeops import first_by, point_window
from cohortspark.plans.inputs import EV, ST, WIN, points, r6, stays, table
from cohortspark.plans.registry import query
from cohortspark.sources import tables
from cohortspark.sources.staging import pinned, shared_top


def folder(spark) -> str:
    """A new folder that all executors share."""
    return f"{shared_top(spark)}/out-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT lpad(c_custkey::VARCHAR, 12, '0') AS code, c_name, c_nationkey, c_acctbal FROM customer")
def csv_round_trip(spark, sf_dir):
    """A1, A2, H1: a delimited file, sorted, read under a declared schema that keeps leading zeros."""
    path = f"{folder(spark)}/customer"
    rows = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("code"), "c_name", "c_nationkey", "c_acctbal")
    tables.write_csv(rows, path, order_by=["code"])
    return tables.read_csv(spark, path, "code string, c_name string, c_nationkey int, c_acctbal double", "|")


@query(
    "stage_tables",
    """SELECT 'customer' AS table_name, count(*) AS n, round(sum(c_acctbal + 1), 2) AS total FROM customer
UNION ALL SELECT 'part', count(*), round(sum(p_retailprice), 2) FROM part UNION ALL SELECT 'urine', 0, 0""",
)
def stage_tables(spark, sf_dir):
    """The more processed version of a table wins; an optional table that no stage has counts for nothing."""
    top = folder(spark)
    tables.write_stage(f"{top}/raw", {n: table(spark, sf_dir, n) for n in ("customer", "part")})
    tables.write_stage(f"{top}/done", {"customer": table(spark, sf_dir, "customer").withColumn("c_acctbal", F.col("c_acctbal") + 1)})
    stages, out = [f"{top}/done", f"{top}/raw"], []
    for name, value, schema in (("customer", "c_acctbal", None), ("part", "p_retailprice", None), ("urine", "value", "value double")):
        total = F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2)
        out.append(tables.read_stage(spark, name, stages, schema).agg(F.count("*").alias("n"), total.alias("total")).select(F.lit(name).alias("table_name"), "n", "total"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "absent_component",
    "WITH " + ST + """, b AS (SELECT stay_id, max(value) AS bili FROM ev WHERE concept = 'signup' GROUP BY 1)
, s AS (SELECT stay_id, CASE WHEN bili / 20 >= 12 THEN 4 WHEN bili / 20 >= 6 THEN 3 WHEN bili / 20 >= 2 THEN 2 WHEN bili / 20 >= 1.2 THEN 1 ELSE 0 END AS liver FROM st LEFT JOIN b USING (stay_id))
SELECT stay_id, liver, 0 AS renal, liver AS total FROM s""",
)
def absent_component(spark, sf_dir):
    """A score whose optional source (urine) no stage has: a warning, and its component is 0 for every stay."""
    top = folder(spark)
    tables.write_stage(f"{top}/raw", {"bilirubin": points(spark, sf_dir).where("concept = 'signup'").select("stay_id", (F.col("value") / 20).alias("value"))})
    bilirubin = tables.read_stage(spark, "bilirubin", [f"{top}/done", f"{top}/raw"])
    urine = tables.read_stage(spark, "urine", [f"{top}/done", f"{top}/raw"], "stay_id long, value double")
    rows = stays(spark, sf_dir).select("stay_id")
    for found, name, worst in ((bilirubin, "bili", F.max), (urine, "urine", F.sum)):
        rows = rows.join(found.groupBy("stay_id").agg(worst("value").alias(name)).hint("merge"), "stay_id", "left")
    liver, renal = clinical.liver(F.col("bili")), F.when(F.col("urine") < 200, 4).when(F.col("urine") < 500, 3).otherwise(0)
    scored = rows.select("stay_id", liver.cast("int").alias("liver"), renal.alias("renal"))
    return scored.withColumn("total", F.col("liver") + F.col("renal"))


@query(
    "partial_rerun",
    """SELECT 'static' AS table_name, 2 AS version, count(*) AS n FROM customer UNION ALL SELECT 'series', 1, count(*) FROM events""",
)
def partial_rerun(spark, sf_dir):
    """Writing one table again leaves the others as they are."""
    top = folder(spark)
    blocks = lambda v: {n: table(spark, sf_dir, t).select(F.lit(v).alias("version")) for n, t in (("static", "customer"), ("series", "events"))}
    tables.write_stage(top, blocks(1))
    tables.write_stage(top, blocks(2), only=["static"])
    both = [tables.read_stage(spark, n, [top]).groupBy("version").agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "version", "n") for n in ("static", "series")]
    return both[0].unionByName(both[1])


@query(
    "concept_sets",
    """SELECT lower(p_type) AS category, list_sort(list(DISTINCT p_size))::VARCHAR AS ids, count(DISTINCT p_size) AS n FROM part GROUP BY 1""",
)
def concept_sets(spark, sf_dir):
    """A dictionary file of concepts, flattened to one row per code and gathered to sets of ids by category."""
    path = f"{folder(spark)}/dictionary"
    parts = table(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("category"), "p_brand").agg(F.collect_set(F.col("p_size").cast("string")).alias("codes"))
    entry = F.struct(F.lit(None).cast("string").alias("display_name"), F.lit("").alias("unit"), "category", "codes")
    entries = parts.select(F.concat("category", F.lit("/"), "p_brand").alias("concept"), entry.alias("e"))
    text = entries.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("concept", "e")))).alias("value"))  # a dictionary is small
    text.coalesce(1).write.text(path)
    sets = tables.concept_ids(tables.read_concepts(spark, path))
    return sets.select("category", F.concat(F.lit("["), F.array_join("ids", ", "), F.lit("]")).alias("ids"), F.size("ids").cast("long").alias("n"))


@query(
    "column_nulls",
    """SELECT 'customer' AS table_name, 'c_acctbal' AS column_name, count(*) FILTER (c_acctbal < 0) AS n_missing, count(*) AS n FROM customer
UNION ALL SELECT 'customer', 'c_custkey', 0, count(*) FROM customer
UNION ALL SELECT 'customer', 'c_gone', count(*), count(*) FROM customer UNION ALL SELECT 'orders', 'o_orderdate', count(*) FILTER (o_orderkey % 7 = 0), count(*) FROM orders""",
)
def column_nulls(spark, sf_dir):
    """Required columns counted over whole tables; a column that is not there is missing in every row."""
    customer = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")))
    return tables.audit_values({"customer": customer, "orders": orders}, {"customer": ["c_custkey", "c_acctbal", "c_gone"], "orders": ["o_orderdate"]})


CHARTED = EV + """, ce AS (SELECT * FROM ev WHERE concept IN ('click', 'view', 'error', 'signup') AND value IS NOT NULL)
, outs AS (
  SELECT 'culture' AS output, stay_id, charttime, NULL::DOUBLE AS value FROM ce WHERE concept = 'signup'
  UNION ALL SELECT 'vitals', stay_id, charttime, value FROM ce WHERE concept = 'click'
  UNION ALL SELECT 'labs', stay_id, charttime, value / 4 FROM ce WHERE concept = 'view'
  UNION ALL SELECT 'ventilation', stay_id, charttime, max((value > 50)::INT)::DOUBLE FROM ce WHERE concept = 'error' GROUP BY 2, 3
  UNION ALL SELECT 'gcs', stay_id, charttime, max(3 + event_id % 13)::DOUBLE FROM ce WHERE concept = 'error' GROUP BY 2, 3)"""


@query("charted_job", "WITH " + CHARTED + " SELECT output, stay_id, count(*) AS n, round(sum(value), 6) AS total FROM outs GROUP BY 1, 2")
def charted_job(spark, sf_dir):
    """The charted events are filtered and written once; five outputs are derived from that table."""
    charted = points(spark, sf_dir).where(F.col("concept").isin("click", "view", "error", "signup") & F.col("value").isNotNull())
    of = lambda c: F.col("concept") == c
    keyed = lambda v: lambda df: df.groupBy("stay_id", "charttime").agg(v.cast("double").alias("value"))
    outputs = tables.split_scan(
        charted,
        {
            "culture": (of("signup"), lambda df: df.select("stay_id", "charttime", F.lit(None).cast("double").alias("value"))),
            "vitals": (of("click"), lambda df: df.select("stay_id", "charttime", "value")),
            "labs": (of("view"), lambda df: df.select("stay_id", "charttime", (F.col("value") / 4).alias("value"))),
            "ventilation": (of("error"), keyed(F.max((F.col("value") > 50).cast("int")))),
            "gcs": (of("error"), keyed(F.max(3 + F.col("event_id") % 13))),
        },
    )
    rows = tables.append_all([df.withColumn("output", F.lit(n)) for n, df in outputs.items()], ["output", "stay_id", "value"])
    return rows.groupBy("output", "stay_id").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query(
    "infusion_job",
    "WITH " + EV + """, ie AS (SELECT * FROM ev WHERE concept IN ('purchase', 'click') AND value IS NOT NULL)
SELECT 'vasopressor' AS output, stay_id, count(*) AS n, round(sum(value / 60), 3) AS total FROM ie WHERE concept = 'purchase' GROUP BY 2
UNION ALL SELECT 'fluid', stay_id, count(*), round(sum(value * CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END), 3) FROM ie WHERE concept = 'click' GROUP BY 2
UNION ALL SELECT 'preadmission', stay_id, 1, round(sum(value), 3) FROM ie WHERE concept = 'click' AND event_id % 5 = 0 GROUP BY 2""",
)
def infusion_job(spark, sf_dir):
    """One scan of infusions gives rates, volumes and the total before admission."""
    infusions = points(spark, sf_dir).where(F.col("concept").isin("purchase", "click") & F.col("value").isNotNull())
    of = lambda c: F.col("concept") == c
    outputs = tables.split_scan(
        infusions,
        {
            "vasopressor": (of("purchase"), lambda df: df.select("stay_id", (F.col("value") / 60).alias("value"))),
            "fluid": (of("click"), lambda df: df.select("stay_id", (F.col("value") * F.when(F.col("event_id") % 3 == 0, 2).otherwise(1)).alias("value"))),
            "preadmission": (of("click") & (F.col("event_id") % 5 == 0), lambda df: df.groupBy("stay_id").agg(F.sum("value").alias("value"))),
        },
    )
    rows = tables.append_all([df.withColumn("output", F.lit(n)) for n, df in outputs.items()], ["output", "stay_id", "value"])
    return rows.groupBy("output", "stay_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("microbiology_times", "WITH " + EV + " SELECT event_id, stay_id, charttime, floor(charttime / 86400) * 86400.0 AS chartdate FROM ev WHERE concept = 'error'")
def microbiology_times(spark, sf_dir):
    """Times and dates of cultures as epoch seconds."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    return rows.select("event_id", F.col("user_id").alias("stay_id"), seconds(F.col("ts")).alias("charttime"), seconds(F.to_date("ts")).alias("chartdate"))


@query("labelling_urine", "WITH " + WIN + " SELECT stay_id, count(*) AS n, round(sum(value - 20), 6) AS total FROM win WHERE concept = 'view' AND value - 20 >= 0 GROUP BY 1")
def labelling_urine(spark, sf_dir):
    """Negative urine volumes are left out of the labelling (not of the export)."""
    rows = point_window(points(spark, sf_dir), stays(spark, sf_dir)).where("concept = 'view'").withColumn("value", F.col("value") - 20)
    return rows.where("value >= 0").groupBy("stay_id").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query(
    "first_rows",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1",
)
def first_rows(spark, sf_dir):
    """The first row of each key in an explicit order."""
    return first_by(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "normal_cohort",
    """SELECT stay_id, min(o_orderkey) AS subject_id, label FROM (
  SELECT o_orderkey, 9007199254740992 + o_custkey AS stay_id, (o_custkey % 2)::BIGINT AS label FROM orders WHERE o_orderkey % 10 <> 3 AND o_orderstatus <> 'P') GROUP BY 1, 3""",
)
def normal_cohort(spark, sf_dir):
    """Ids that arrive as text become whole numbers, rows without one go, of each stay the first row stays."""
    rows = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 10 == 3, "none").otherwise(F.concat((F.col("o_custkey") + 2**53).cast("string"), F.lit(".0"))).alias("stay_id"),
        F.col("o_orderkey").cast("string").alias("subject_id"),
        F.when(F.col("o_orderstatus") != "P", (F.col("o_custkey") % 2).cast("double")).alias("label"),
    )
    return C.normal_cohort(rows).select("stay_id", "subject_id", "label")


@query(
    "both_arms",
    "WITH " + ST + """ SELECT stay_id, label, CASE WHEN label = 1 THEN outtime END AS onset_time, t0 AS prediction_time FROM st""",
)
def both_arms(spark, sf_dir):
    """S3: positives and controls under one layout; controls have no onset."""
    s = stays(spark, sf_dir).withColumnRenamed("t0", "prediction_time")
    positives = s.where("label = 1").select("stay_id", "label", F.col("outtime").alias("onset_time"), "prediction_time")
    controls = s.where("label = 0").select("stay_id", "label", "prediction_time")
    return tables.append_all([positives, controls], ["stay_id", "label", "onset_time", "prediction_time"])


@query(
    "organ_scores",
    "WITH " + WIN + """, o AS (SELECT stay_id, max(CASE WHEN concept = 'signup' THEN value / 20 END) AS bili, min(CASE WHEN concept = 'click' THEN value END) AS pao2,
  max(CASE WHEN concept = 'view' THEN 21 + value % 80 END) AS fio2, min(CASE WHEN concept = 'error' THEN value END) AS spo2, max(CASE WHEN concept = 'purchase' THEN event_id % 2 END) AS vent FROM win GROUP BY 1)
, q AS (SELECT *, pao2 / (fio2 / 100) AS r, least(spo2, 97) / (fio2 / 100) AS s FROM o)
SELECT stay_id, CASE WHEN bili >= 12 THEN 4 WHEN bili >= 6 THEN 3 WHEN bili >= 2 THEN 2 WHEN bili >= 1.2 THEN 1 ELSE 0 END AS liver,
  CASE WHEN r IS NOT NULL THEN CASE WHEN r < 100 AND vent = 1 THEN 4 WHEN r < 200 AND vent = 1 THEN 3 WHEN r < 300 THEN 2 WHEN r < 400 THEN 1 ELSE 0 END
       WHEN spo2 IS NOT NULL AND fio2 IS NOT NULL THEN CASE WHEN s <= 67 THEN 4 WHEN s <= 142 THEN 3 WHEN s <= 221 THEN 2 WHEN s <= 302 THEN 1 ELSE 0 END ELSE 0 END AS respiration FROM q""",
)
def organ_scores(spark, sf_dir):
    """Liver and respiration scores from worst values in the window."""
    rows = point_window(points(spark, sf_dir), stays(spark, sf_dir))
    of = lambda c, v=F.col("value"): F.when(F.col("concept") == c, v)
    worst = rows.groupBy("stay_id").agg(
        F.max(of("signup", F.col("value") / 20)).alias("bili"), F.min(of("click")).alias("pao2"), F.max(of("view", 21 + F.col("value") % 80)).alias("fio2"),
        F.min(of("error")).alias("spo2"), F.max(of("purchase", F.col("event_id") % 2)).alias("vent"),
    )
    breath = clinical.respiration(F.col("pao2"), F.col("fio2"), F.col("spo2"), F.col("vent") == 1)
    return worst.select("stay_id", clinical.liver(F.col("bili")).alias("liver"), breath.alias("respiration"))


@query("guarded_window", "WITH " + WIN + " SELECT event_id, round(hours_before, 6) AS hours_before FROM win")
def guarded_window(spark, sf_dir):
    """C11: the export read under guards that raise on rows after the prediction or before the window."""
    rows = point_window(points(spark, sf_dir), stays(spark, sf_dir))
    return G.guarded_window(rows, 24).select("event_id", r6("hours_before").alias("hours_before"))


@query(
    "component_gate",
    "WITH " + EV + " SELECT 'gcs_in_range' AS gate, count(*) = 0 AS passed, count(*) AS n_bad FROM ev WHERE concept = 'error' AND NOT 2 + event_id % 15 BETWEEN 3 AND 15",
)
def component_gate(spark, sf_dir):
    """The sum of the components lies within 3 to 15 (some rows here do not)."""
    rows = points(spark, sf_dir).where("concept = 'error'").withColumn("gcs", 2 + F.col("event_id") % 15)
    return G.component_sum(rows)


@query(
    "balance_gate",
    "WITH " + ST + """, x AS (SELECT label, t0 - intime AS v FROM st), s AS (SELECT avg(v) FILTER (label = 1) - avg(v) FILTER (label = 0) AS d, sqrt((var_pop(v) FILTER (label = 1) + var_pop(v) FILTER (label = 0)) / 2) AS sd FROM x)
SELECT 'offset_balance' AS gate, abs(d / sd) < 0.1 AS passed, round(d / sd, 6) AS smd FROM s""",
)
def balance_gate(spark, sf_dir):
    """The arms' offsets differ by less than 0.1 standard deviations."""
    rows = stays(spark, sf_dir).withColumn("offset_s", F.col("t0") - F.col("intime"))
    return G.balance(rows, "label", "offset_s").withColumn("smd", r6("smd"))
