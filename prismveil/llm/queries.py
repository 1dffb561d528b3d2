"""Queries of the training-data problems tagged llm, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismveil.llm import digest, encoding, junk, packing, pii
from prismveil.plans.storage import materialise, table

SHARES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: Tokens in a container.
CAPACITY = 2048


def tokenizer(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> tuple[Broadcast, str]:
    """Rank file (``path``, else ``name`` of the installed public tokenizers) and its pattern."""
    import public_tokenizers

    return encoding.vocabulary(spark, path or public_tokenizers.path(name)), public_tokenizers.PATTERN


# ---- 1: percentiles from mergeable partial results --------------------------------------


def p1_partials(spark: SparkSession, sf: str) -> DataFrame:
    """One digest of latency_ms per provider, model and delivery; every delivered row counts."""
    by = ("provider", "model", "delivery_no")
    return digest.merge_digests(digest.partial_digests(table(spark, sf, "audit_chain_py"), by, "latency_ms"), by)


def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of latency_ms per provider and model, merged from the stored partials, with
    the rank error counted over all rows."""
    by = ("provider", "model")
    stored = materialise(p1_partials(spark, sf), "p1-partials")
    found = materialise(digest.percentiles(digest.merge_digests(stored, by), by, SHARES), "p1-percentiles")
    return digest.certify(table(spark, sf, "audit_chain_py"), found, by, "latency_ms", SHARES)


def p1_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """What the digests hold exactly: numbers of values and of skipped ones, least and greatest."""
    by = ("provider", "model")
    return digest.merge_digests(digest.partial_digests(table(spark, sf, "audit_chain_py"), by, "latency_ms"), by).select(*by, "n_values", "n_skipped", "lo", "hi")


# ---- 2: personal data in messages ---------------------------------------------------------


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every mention of personal data in messages, a re-sent message counting once."""
    spans = pii.with_spans(table(spark, sf, "messages"), "content", pii.model(spark), ["conv_id", "turn"])
    return spans.select("conv_id", "turn", F.explode("spans").alias("s")).select("conv_id", "turn", "s.start_pos", "s.category").distinct()


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The messages with typed placeholders in place of personal data."""
    return pii.redact(table(spark, sf, "messages"), "content", pii.model(spark))


# ---- 6: ids of a public tokenizer -------------------------------------------------------


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id`` and ``ids`` of each document by byte_bpe_50k, without special tokens."""
    ranks, pattern = tokenizer(spark)
    return encoding.encode(table(spark, sf, "documents"), "text", ranks, pattern, ["doc_id"])


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The texts as decoded from their ids: what went in, null as an empty text."""
    ranks, _ = tokenizer(spark)
    return encoding.decode(p6_ids(spark, sf), "ids", ranks, ["doc_id"])


# ---- 7: containers of fixed capacity ----------------------------------------------------


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of each part of each document, 2,048 tokens of byte_bpe_50k in each."""
    ranks, pattern = tokenizer(spark)
    sizes = materialise(packing.measure(table(spark, sf, "documents"), "doc_id", "text", ranks, pattern), "p7-sizes")
    return packing.containers(sizes, "doc_id", CAPACITY, sizes.count())


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Every container with its parts, tokens and unused space."""
    return (
        p7_containers(spark, sf)
        .groupBy("container_id")
        .agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn("unused", F.lit(CAPACITY) - F.col("n_tokens"))
    )


# ---- 8: template residue and error pages --------------------------------------------------


def _junk(spark: SparkSession, sf: str) -> DataFrame:
    stored = materialise(junk.mined(table(spark, sf, "documents"), "doc_id", "text"), "p8-lines")
    merged = junk.merged_templates(stored.filter(F.col("_t").isNotNull()).select("_text", "_n"))
    return junk.junk_documents(stored, materialise(junk.template_verdicts(merged), "p8-verdicts"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with a placeholder, filler, an error page or a notice in place of content."""
    return _junk(spark, sf).select(F.col("_key").alias("doc_id"))


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without those of p8_found; null, empty and blank texts are kept."""
    return table(spark, sf, "documents").join(p8_found(spark, sf), "doc_id", "left_anti")


def p8_templates(spark: SparkSession, sf: str) -> DataFrame:
    """The merged line templates with their numbers of lines and their verdicts."""
    stored = materialise(junk.mined(table(spark, sf, "documents"), "doc_id", "text"), "p8-lines")
    merged = junk.merged_templates(stored.filter(F.col("_t").isNotNull()).select("_text", "_n"))
    verdicts = junk.template_verdicts(merged)
    return verdicts.groupBy(F.col("_now").alias("template"), "verdict").agg(F.sum("_n").alias("n_lines"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_partials, p1_extremes, p2_found, p2_redacted, p6_ids, p6_round_trip, p7_containers, p7_fill, p8_found, p8_kept, p8_templates)}

ORACLES: dict[str, str] = {
    "p1_extremes": """
        SELECT provider, model, count(*) FILTER (WHERE isfinite(latency_ms)) AS n_values,
               count(*) FILTER (WHERE latency_ms IS NULL OR NOT isfinite(latency_ms)) AS n_skipped,
               min(latency_ms) FILTER (WHERE isfinite(latency_ms)) AS lo, max(latency_ms) FILTER (WHERE isfinite(latency_ms)) AS hi
        FROM audit_chain_py GROUP BY provider, model""",
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
