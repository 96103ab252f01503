"""The registered queries of the thirteen operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspark.llm import alignment, bpe, embeddings, mixing, oracles, quality, rollups, secrets, sharding, simhash, toxicity, urls, warc, whitening
from cohortspark.llm.shared import shared_folder, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, score and verdict of every document."""
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op9_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint_bits")).alias("fingerprint"), "component_id")


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    coded = bpe.encode_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_secret_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document: counts and digest of the base kinds, and all spans."""
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[secrets.count_of(spans, kind).alias(f"n_{kind}") for kind in secrets.BASE_KINDS],
        F.sha2(secrets.spans_text(spans, secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.spans_text(spans).alias("spans"),
    )


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by row counts."""
    docs = _table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    thin = docs.select("doc_id", size, F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.sharded(thin, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix of its source takes."""
    docs = _table(spark, sf_dir, "documents")
    mixed = mixing.with_goals(*mixing.mix(docs))
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken)


def op8_int8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back."""
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_url_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = urls.labelled_urls(pages, _table(spark, sf_dir, "labels"))
    return urls.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "blocked_by")


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents come in, exact copies leave, every count is revised by its end token.

    The second batch is applied twice, as after a lost acknowledgement; the totals must not show it.
    """
    docs = _table(spark, sf_dir, "documents")
    version = "word_bpe_49k"
    tokens = bpe.counted(spark, F.col("text"))
    counted = staged(docs.select("doc_id", "source", "lang", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha"), tokens.alias("n")))
    store = rollups.Store(spark, shared_folder(spark))
    store.commit(1, rollups.changes_of(counted, "insert", version, 1, F.col("n")))
    first = staged(counted.groupBy("h", "sha").agg(F.min("doc_id").alias("first_id")))
    copies = counted.join(first.hint("merge"), ["h", "sha"]).where("doc_id > first_id")
    copies = staged(copies.select("doc_id", "source", "lang", "n"))
    leave = rollups.changes_of(copies, "delete", version, 2, F.lit(None))
    for _ in range(2):
        store.commit(2, leave)
    store.commit(3, rollups.changes_of(store.ledger(), "revise", version, 3, F.col("n_tokens") + 1))
    return store.totals()


def op11_jacobi_davidson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every vector."""
    found = whitening.whitened(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and verdict of every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_anchor_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both tokenizers' ids in every document, by counts and a digest of the groups."""
    found = alignment.align_documents(_table(spark, sf_dir, "documents"), keep_groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op6_token_rollups": op6_token_rollups,
    "op2_url_association": op2_url_association,
    "op7_warc_zstd": op7_warc_zstd,
    "op8_int8_near_dup": op8_int8_near_dup,
    "op1_feistel_shards": op1_feistel_shards,
    "op5_flow_mix": op5_flow_mix,
    "op3_secret_structure": op3_secret_structure,
    "op4_bpe_automaton": op4_bpe_automaton,
    "op9_simhash_near_dup": op9_simhash_near_dup,
    "op10_quality_llr": op10_quality_llr,
    "op11_jacobi_davidson": op11_jacobi_davidson,
    "op12_weak_supervision": op12_weak_supervision,
    "op13_anchor_alignment": op13_anchor_alignment,
}

ORACLES: dict[str, str] = {
    "op1_feistel_shards": oracles.SHARDS,
    "op7_warc_zstd": oracles.WARC,
    "op8_int8_near_dup": oracles.COSINE_COMPONENTS,
    "op2_url_association": oracles.URLS,
}
