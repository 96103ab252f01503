"""Queries of the extraction stage: joins, code ladders, flags, pivots, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortspark.functions import clinical
from cohortspark.functions.columns import concept_name, decimal_rounded, epoch_seconds, to_id, to_number
from cohortspark.operators import timeops
from cohortspark.plans.inputs import EV, intervals, points, r6, table
from cohortspark.plans.registry import query
from cohortspark.sources.tables import append_all, audit_columns

# Order of tests matters: the first name that a text contains gives the code.
SEGMENTS = [("BUILD", 1), ("HOUSE", 2), ("MACH", 3), ("AUTO", 4), ("FURN", 5)]


@query(
    "extract_demog",
    """
WITH o AS (
  SELECT o.*, c.c_mktsegment, c.c_acctbal, n.n_name, epoch_us(o_orderdate) / 1e6 AS admit,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS adm_order,
         lag(epoch_us(o_orderdate) / 1e6 + 86400.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev
  FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey
), l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, admit, adm_order::INT AS adm_order, coalesce(l.n, 0)::BIGINT AS n_lines, n_name,
       (30 + year(o_orderdate) - 1992)::INT AS age,
       CASE WHEN 30 + year(o_orderdate) - 1992 <= 50 THEN 0 WHEN 30 + year(o_orderdate) - 1992 <= 60 THEN 1 WHEN 30 + year(o_orderdate) - 1992 <= 70 THEN 2
            WHEN 30 + year(o_orderdate) - 1992 <= 80 THEN 3 ELSE 4 END AS age_points,
       CASE WHEN c_mktsegment LIKE '%BUILD%' THEN 1 WHEN c_mktsegment LIKE '%HOUSE%' THEN 2 WHEN c_mktsegment LIKE '%MACH%' THEN 3
            WHEN c_mktsegment LIKE '%AUTO%' THEN 4 WHEN c_mktsegment LIKE '%FURN%' THEN 5 ELSE 0 END AS unit,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS gender,
       CASE WHEN admit - prev >= 0 AND admit - prev <= 30 * 86400.0 THEN 1 ELSE 0 END AS readmitted
FROM o LEFT JOIN l ON o_orderkey = l_orderkey
""",
)
def extract_demog(spark, sf_dir):
    """One row per admission."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    counts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(counts, "o_orderkey", "left")
    admit, age = epoch_seconds(F.col("o_orderdate")), (30 + F.year("o_orderdate") - 1992).cast("int")
    rows = rows.withColumns({"admit": admit, "discharge": admit + 86400.0, "age": age})
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = timeops.readmission(rows.withColumn("adm_order", rank), "o_custkey", "admit", "discharge", ["o_orderdate", "o_orderkey"])
    gender = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
    return rows.select(
        "o_orderkey", "admit", "adm_order", F.coalesce("n", F.lit(0)).alias("n_lines"), "n_name", "age",
        clinical.age_points(F.col("age")).alias("age_points"),
        clinical.unit_code(F.col("c_mktsegment"), SEGMENTS).alias("unit"), gender.alias("gender"), "readmitted",
    )


RULES = [
    clinical.CodeRule("steel", 1, 5, "ECONO", "MEDIU"),
    clinical.CodeRule("brand", 2, 7, "Brand#1", "Brand#2"),
    clinical.CodeRule("severe", 2, 8, "Brand#31", "Brand#35"),
    clinical.CodeRule("severe", 1, 3, "STA", "STZ"),
]


@query(
    "prefix_flags_index",
    """
WITH c AS (SELECT l_orderkey, 1 AS v, p_type AS code FROM lineitem JOIN part ON l_partkey = p_partkey
           UNION ALL SELECT l_orderkey, 2, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
, f AS (SELECT l_orderkey,
  max(CASE WHEN v = 1 AND substr(code, 1, 5) BETWEEN 'ECONO' AND 'MEDIU' THEN 1 ELSE 0 END) AS steel,
  max(CASE WHEN v = 2 AND substr(code, 1, 7) BETWEEN 'Brand#1' AND 'Brand#2' THEN 1 ELSE 0 END) AS brand,
  max(CASE WHEN (v = 2 AND substr(code, 1, 8) BETWEEN 'Brand#31' AND 'Brand#35') OR (v = 1 AND substr(code, 1, 3) BETWEEN 'STA' AND 'STZ') THEN 1 ELSE 0 END) AS severe
  FROM c GROUP BY 1)
SELECT l_orderkey, steel, brand, severe, greatest(brand, 3 * severe) + steel AS weighted FROM f
""",
)
def prefix_flags_index(spark, sf_dir):
    """Category flags by code prefixes of two versions in one pass, and a weighted index where the worse form supersedes."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    codes = joined.select("l_orderkey", F.explode(F.array(F.struct(F.lit(1).alias("v"), F.col("p_type").alias("code")), F.struct(F.lit(2).alias("v"), F.col("p_brand").alias("code")))).alias("c"))
    flags = clinical.category_flags(RULES, F.col("c.code"), F.col("c.v"))
    rows = codes.groupBy("l_orderkey").agg(*[f.alias(n) for n, f in flags.items()])
    return rows.withColumn("weighted", F.greatest(F.col("brand"), 3 * F.col("severe")) + F.col("steel"))


@query(
    "dose_normalise",
    """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_returnflag = 'A' AND l_discount > 0.05 THEN round((l_discount * 10)::DECIMAL(18,3), 3)::DOUBLE
       WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN round((l_discount * 2.5)::DECIMAL(18,3), 3)::DOUBLE
       WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN round((l_discount / 80)::DECIMAL(18,3), 3)::DOUBLE
       WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN round(l_discount::DECIMAL(18,3), 3)::DOUBLE END AS rate_std,
  CASE l_returnflag WHEN 'A' THEN l_quantity * 1.5 WHEN 'R' THEN l_quantity * 0.5 ELSE l_quantity END AS volume,
  CASE WHEN l_tax <> 0 THEN l_quantity * l_discount / l_tax END AS norm_rate
FROM lineitem
""",
)
def dose_normalise(spark, sf_dir):
    """Dose by drug and unit (first rule wins, unknown pairs null), volume by type, guarded ratio."""
    flag, status, rate = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_discount")
    dose = clinical.ladder(
        [
            ((flag == "A") & (rate > 0.05), decimal_rounded(rate * 10)),
            ((flag == "A") & (status == "F"), decimal_rounded(rate * 2.5)),
            ((flag == "R") & (status == "F"), decimal_rounded(rate / 80)),
            ((flag == "N") & (status == "O"), decimal_rounded(rate)),
        ]
    )
    volume = F.when(flag == "A", F.col("l_quantity") * 1.5).when(flag == "R", F.col("l_quantity") * 0.5).otherwise(F.col("l_quantity"))
    ratio = F.try_divide(F.col("l_quantity") * rate, F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dose.alias("rate_std"), volume.alias("volume"), ratio.alias("norm_rate"))


@query(
    "coded_states",
    "WITH " + EV + """
SELECT DISTINCT stay_id, charttime,
  max(CASE WHEN concept IN ('purchase', 'signup') OR (concept = 'click' AND value > 250) THEN 1 ELSE 0 END) OVER (PARTITION BY stay_id, charttime) AS on_support,
  max(CASE WHEN concept LIKE 'vi%' THEN 4 WHEN concept LIKE 'cl%' THEN 2 ELSE floor(value / 100) END) OVER (PARTITION BY stay_id, charttime) AS device
FROM ev
""",
)
def coded_states(spark, sf_dir):
    """Binary state and device ordinal per stay and time from several codes."""
    c, v = F.col("concept"), F.col("value")
    on = F.when(c.isin("purchase", "signup") | ((c == "click") & (v > 250)), 1).otherwise(0)
    device = F.when(c.startswith("vi"), 4.0).when(c.startswith("cl"), 2.0).otherwise(F.floor(v / 100).cast("double"))
    return points(spark, sf_dir).groupBy("stay_id", "charttime").agg(F.max(on).alias("on_support"), F.max(device).alias("device"))


@query(
    "component_pivot",
    "WITH " + EV + """
, p AS (SELECT stay_id, floor(charttime / 86400)::BIGINT AS day, max(CASE WHEN concept = 'click' THEN value END) AS eye,
  max(CASE WHEN concept = 'view' THEN value END) AS verbal, max(CASE WHEN concept = 'error' THEN value END) AS motor FROM ev GROUP BY 1, 2)
SELECT stay_id, day, round(eye + verbal + motor, 6) AS total FROM p WHERE eye IS NOT NULL AND verbal IS NOT NULL AND motor IS NOT NULL
""",
)
def component_pivot(spark, sf_dir):
    """Three components per stay and time, summed where all are there."""
    of = lambda c: F.max(F.when(F.col("concept") == c, F.col("value")))
    rows = points(spark, sf_dir).groupBy("stay_id", F.floor(F.col("charttime") / 86400).alias("day"))
    rows = rows.agg(of("click").alias("eye"), of("view").alias("verbal"), of("error").alias("motor")).dropna()
    return rows.select("stay_id", "day", r6(F.col("eye") + F.col("verbal") + F.col("motor")).alias("total"))


@query(
    "tolerance_join",
    """
SELECT o_orderkey, l_linenumber, epoch_us(l_shipdate) / 1e6 AS charttime FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate >= o_orderdate - INTERVAL 1 DAY AND l_shipdate <= o_orderdate + INTERVAL 30 DAY
""",
)
def tolerance_join(spark, sf_dir):
    """Equi join with a time tolerance."""
    day = F.expr("interval 1 day")
    joined = timeops.tolerance_join(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"),
        F.col("l_shipdate"), F.col("o_orderdate") - day, F.col("o_orderdate") + day * 30,
    )
    return joined.select("o_orderkey", "l_linenumber", epoch_seconds(F.col("l_shipdate")).alias("charttime"))


BLOCKS = EV + """, b AS (SELECT *, floor(charttime / 432000)::BIGINT AS block FROM ev)
, stays AS (SELECT stay_id AS parent, stay_id * 100000 + block AS stay_id, min(charttime) AS intime, max(charttime) AS outtime FROM b WHERE block % 2 = 0 GROUP BY b.stay_id, block)"""


@query(
    "attribute_events",
    "WITH " + BLOCKS + """
, e AS (SELECT event_id, stay_id AS parent, CASE WHEN event_id % 50 = 0 THEN NULL ELSE charttime END AS time FROM b WHERE block % 2 = 1)
SELECT event_id, parent, time, CASE WHEN time IS NULL THEN NULL ELSE coalesce(
  (SELECT arg_min(s.stay_id, (s.intime, s.stay_id)) FROM stays s WHERE s.parent = e.parent AND e.time BETWEEN s.intime - 172800 AND s.outtime + 172800),
  (SELECT CASE WHEN count(*) = 1 THEN min(s.stay_id) END FROM stays s WHERE s.parent = e.parent)) END AS stay_id
FROM e
""",
)
def attribute_events(spark, sf_dir):
    """Events without a stay go to the first stay of their parent that holds them, else to its only one."""
    b = points(spark, sf_dir).withColumn("block", F.floor(F.col("charttime") / 432000)).withColumnRenamed("stay_id", "parent")
    even = b.where("block % 2 = 0").groupBy("parent", (F.col("parent") * 100000 + F.col("block")).alias("stay_id"))
    even = even.agg(F.min("charttime").alias("intime"), F.max("charttime").alias("outtime"))
    time = F.when(F.col("event_id") % 50 != 0, F.col("charttime")).alias("time")
    return timeops.attribute_events(b.where("block % 2 = 1").select("event_id", "parent", time), even)


@query(
    "clean_values",
    """
SELECT doc_id, CASE WHEN regexp_replace(regexp_replace(lower(trim(source || ' -' || lang || '! ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'unknown'
  ELSE regexp_replace(regexp_replace(lower(trim(source || ' -' || lang || '! ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS concept,
  try_cast(regexp_replace(source, 'src', '') AS DOUBLE) AS number, TRY_CAST(n_chars || '.0' AS DOUBLE)::BIGINT AS id, try_cast(lang AS DOUBLE) AS nothing
FROM documents
""",
)
def clean_values(spark, sf_dir):
    """Numbers, ids and concept names from text."""
    name = F.concat("source", F.lit(" -"), "lang", F.lit("! "))
    return table(spark, sf_dir, "documents").select(
        "doc_id", concept_name(name).alias("concept"), to_number(F.regexp_replace("source", "src", "")).alias("number"),
        to_id(F.concat(F.col("n_chars").cast("string"), F.lit(".0"))).alias("id"), to_number(F.col("lang")).alias("nothing"),
    )


@query(
    "allow_lists",
    """
SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_brand IN ('Brand#12', 'Brand#23', 'Brand#34') AND l_returnflag IN ('A', 'R') AND l_linestatus <> 'X'
""",
)
def allow_lists(spark, sf_dir):
    """Allow-lists as literals and as a semi join, three-valued inequality."""
    wanted = spark.range(3).select(F.element_at(F.array(*map(F.lit, ["Brand#12", "Brand#23", "Brand#34"])), (F.col("id") + 1).cast("int")).alias("p_brand"))
    parts = table(spark, sf_dir, "part").join(F.broadcast(wanted), "p_brand", "left_semi")
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_linestatus") != "X"))
    return rows.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand")


@query(
    "preadmission_totals",
    "WITH " + EV + "SELECT stay_id, round(sum(value), 6) AS total FROM ev WHERE concept = 'signup' AND value IS NOT NULL GROUP BY 1",
)
def preadmission_totals(spark, sf_dir):
    """One sum per stay from a filtered scan."""
    rows = points(spark, sf_dir).where("concept = 'signup' and value is not null")
    return rows.groupBy("stay_id").agg(r6(F.sum("value")).alias("total"))


@query(
    "union_sources",
    "WITH " + EV + """
SELECT stay_id, coalesce(charttime, 0) AS charttime, 'a' AS source FROM ev WHERE concept = 'error'
UNION ALL SELECT stay_id, floor(charttime / 86400) * 86400.0, 'b' FROM ev WHERE concept = 'signup'
""",
)
def union_sources(spark, sf_dir):
    """Two sources under one layout, the time of the second being its date."""
    p = points(spark, sf_dir)
    one = p.where("concept = 'error'").select("stay_id", "charttime", F.lit("a").alias("source"))
    date = (F.floor(F.col("charttime") / 86400) * F.lit(86400.0)).alias("chartdate")
    two = p.where("concept = 'signup'").select("stay_id", date, F.lit("b").alias("source"))
    rows = append_all([one, two], ["stay_id", "charttime", "chartdate", "source"])
    return rows.select("stay_id", F.coalesce("charttime", "chartdate").alias("charttime"), "source")


@query(
    "audit_columns",
    """
SELECT * FROM (VALUES ('customer', 'incomplete', 'c_missing'), ('orders', 'ok', ''), ('nowhere', 'absent', 'a,b')) t(table_name, status, missing)
WHERE (SELECT count(*) FROM orders) >= 0
""",
)
def audit(spark, sf_dir):
    """Required columns of several tables."""
    tables = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    return audit_columns(spark, tables, {"customer": ["c_custkey", "c_missing"], "orders": ["o_orderkey", "o_totalprice"], "nowhere": ["b", "a"]})


@query(
    "set_intersect",
    "SELECT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
)
def set_intersect(spark, sf_dir):
    """Ids in both sets."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderpriority", "o_orderstatus")
    return o.where("o_orderpriority = '1-URGENT'").select("id").intersect(o.where("o_orderstatus = 'F'").select("id"))


@query("set_except", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_except(spark, sf_dir):
    """Ids of one set that the other lacks."""
    some = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(some)


@query(
    "interval_events",
    "WITH " + EV + "SELECT event_id, stay_id, concept, charttime AS starttime, CASE WHEN concept <> 'signup' THEN charttime + value * 60.0 END AS endtime, value AS amount FROM ev",
)
def interval_events(spark, sf_dir):
    """Point rows in the interval layout."""
    return intervals(spark, sf_dir)
