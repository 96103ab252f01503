"""The driver's tables in the roles of the pipeline, in Spark and as SQL preludes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions.columns import hash_uniform
from cohortspark.streaming.export import points_of

CONCEPTS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point events: stay_id, charttime, concept, value, event_id."""
    return points_of(table(spark, sf_dir, "events"))


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stay per user, from its first to its last event; t0 after 60 % of it, 24 hours of look-back."""
    spans = points(spark, sf_dir).groupBy("stay_id").agg(F.min("charttime").alias("intime"), F.max("charttime").alias("outtime"))
    t0 = F.col("intime") + 0.6 * (F.col("outtime") - F.col("intime"))
    spans = spans.withColumns({"t0": t0, "label": (F.col("stay_id") % 2).cast("int")})
    return spans.withColumn("lower_bound", F.col("t0") - 86400.0)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval events of value minutes; sign-ups have no end."""
    p = points(spark, sf_dir)
    end = F.when(F.col("concept") != "signup", F.col("charttime") + F.col("value") * 60.0)
    return p.select("event_id", "stay_id", "concept", F.col("charttime").alias("starttime"), end.alias("endtime"), F.col("value").alias("amount"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stay_id (the document), y, prob of model a, prob_b of a random model, lang."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("stay_id"),
        F.col("quality").alias("y"),
        (F.least(F.col("n_chars"), F.lit(5000)) / F.lit(5000.0)).alias("prob"),
        hash_uniform(1, F.col("doc_id")).alias("prob_b"),
        "lang",
        "n_chars",
    )


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


EV = """ev AS (SELECT event_id, user_id AS stay_id, epoch_us(ts) / 1e6 AS charttime, event_type AS concept, value FROM events)"""
ST = EV + """, st AS (
  SELECT *, t0 - 86400.0 AS lower_bound FROM (
    SELECT stay_id, min(charttime) AS intime, max(charttime) AS outtime,
           min(charttime) + 0.6 * (max(charttime) - min(charttime)) AS t0, (stay_id % 2)::INT AS label
    FROM ev GROUP BY stay_id))"""
WIN = ST + """, win AS (
  SELECT ev.*, st.t0, st.lower_bound, (st.t0 - charttime) / 3600.0 AS hours_before FROM ev JOIN st USING (stay_id)
  WHERE charttime >= lower_bound AND charttime <= t0)"""
IV = ST + """, iv AS (
  SELECT event_id, stay_id, concept, charttime AS starttime,
         CASE WHEN concept <> 'signup' THEN charttime + value * 60.0 END AS endtime, value AS amount FROM ev)
, iw AS (
  SELECT *, observed_end - observed_start AS observed_s, endtime - starttime AS original_s, (t0 - observed_end) / 3600.0 AS hours_before
  FROM (SELECT iv.event_id, iv.stay_id, iv.concept, iv.starttime, coalesce(iv.endtime, iv.starttime) AS endtime, iv.amount, st.t0,
               greatest(iv.starttime, st.lower_bound) AS observed_start, least(coalesce(iv.endtime, iv.starttime), st.t0) AS observed_end
        FROM iv JOIN st USING (stay_id)
        WHERE iv.starttime <= st.t0 AND coalesce(iv.endtime, iv.starttime) >= st.lower_bound))"""
PR = """pr AS (SELECT d.doc_id AS stay_id, l.quality AS y, least(d.n_chars, 5000) / 5000.0::DOUBLE AS prob,
  ('0x' || substr(md5('1:' || d.doc_id), 1, 8))::BIGINT / 4294967296.0 AS prob_b, d.lang, d.n_chars
  FROM documents d JOIN labels l USING (doc_id))"""
SG = PR + """, g AS (SELECT prob, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM pr GROUP BY prob)
, sg AS (SELECT *, sum(pos) OVER (ORDER BY prob DESC) AS tp, sum(neg) OVER (ORDER BY prob DESC) AS fp,
  sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM g)"""
