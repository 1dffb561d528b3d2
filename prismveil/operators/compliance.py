"""Rollups of an audit log: per article, per decision, content, keys and revocations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(n: Column, d: Column) -> Column:
    """``n / d`` in percent with two decimals, halves up, in whole numbers; 0 for ``d`` = 0."""
    whole = F.floor((F.lit(10000) * n + F.floor(d / 2)) / d)
    return F.when(d == 0, 0.0).otherwise(whole.cast("double") / 100)


def in_period(timestamp: Column, start: str | None, end: str | None) -> Column:
    """Inclusive, as texts; an entry without a timestamp is never in a period."""
    ok = timestamp.isNotNull() & (timestamp != "")
    if start is not None:
        ok &= timestamp >= start
    if end is not None:
        ok &= timestamp <= end
    return F.coalesce(ok, F.lit(False))


def scoped(entries: DataFrame, start: str | None = None, end: str | None = None, articles: Sequence[str] | None = None) -> DataFrame:
    kept = entries.filter(in_period(F.col("timestamp"), start, end))
    return kept if articles is None else kept.filter(F.coalesce(F.arrays_overlap("article_ref", F.array(*map(F.lit, articles))), F.lit(False)))


def per_article(entries: DataFrame, requested: Sequence[str] | None = None) -> DataFrame:
    """One row per article: evidence, decisions, sessions, findings, wipes, content, flags.

    An entry counts once for each time it names an article.  Requested articles without
    evidence have a row of zeros.
    """
    rows = entries.select(F.explode("article_ref").alias("article"), "decision_id", "event_type", "bias_context", "content_context", "pii_in_log").filter(F.col("article").isNotNull())
    event, synthetic = F.col("event_type"), F.coalesce(F.col("content_context.synthetic"), F.lit(False))
    made = (event == "content_generation") & synthetic
    n = lambda cond: F.count(F.when(cond, 1))
    out = (
        rows.groupBy("article")
        .agg(
            F.count(F.lit(1)).alias("evidence_count"),
            F.countDistinct(F.nullif("decision_id", F.lit(""))).alias("decision_count"),
            n(event == "bias_session_start").alias("bias_sessions"),
            n(event == "bias_finding").alias("bias_findings"),
            n(event == "bias_session_end").alias("bias_ends"),
            n((event == "bias_session_end") & F.col("bias_context.wipe_confirmed")).alias("bias_wiped"),
            n(made).alias("content_generated"),
            n(made & F.col("content_context.labeled")).alias("content_labeled"),
            n(made & F.col("content_context.deepfake")).alias("content_deepfake"),
            F.coalesce(F.bool_or("pii_in_log"), F.lit(False)).alias("pii_in_log"),
        )
        .withColumn("wipe_pct", percent(F.col("bias_wiped"), F.col("bias_ends")))
        .withColumn("label_pct", percent(F.col("content_labeled"), F.col("content_generated")))
    )
    if requested is None:
        return out
    asked = entries.sparkSession.createDataFrame([(a,) for a in requested], "article string")
    return asked.join(out, "article", "left").fillna(0).fillna(False, ["pii_in_log"])


def per_article_categories(entries: DataFrame) -> DataFrame:
    """Category counts per article."""
    rows = entries.select(F.explode("article_ref").alias("article"), "categories").filter(F.col("article").isNotNull())
    return rows.select("article", F.explode("categories").alias("category", "n")).filter(F.col("n").isNotNull()).groupBy("article", "category").agg(F.sum("n").alias("n"))


def per_decision(entries: DataFrame) -> DataFrame:
    """One row per decision: entries, articles in order, first and last timestamp."""
    rows = entries.filter(F.coalesce(F.col("decision_id") != "", F.lit(False)))
    return rows.groupBy("decision_id").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("article_ref")))), ",").alias("articles"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def content_modalities(entries: DataFrame) -> DataFrame:
    """Synthetic content per modality with labeled and deepfake counts."""
    made = entries.filter((F.col("event_type") == "content_generation") & F.col("content_context.synthetic"))
    return made.groupBy(F.col("content_context.modality").alias("modality")).agg(
        F.count(F.lit(1)).alias("generated"), F.count(F.when(F.col("content_context.labeled"), 1)).alias("labeled"), F.count(F.when(F.col("content_context.deepfake"), 1)).alias("deepfake")
    )


def attestation_counts(entries: DataFrame) -> DataFrame:
    """Entries with a certificate and distinct keys, per key."""
    signed = entries.filter(F.coalesce(F.col("certificate_hash") != "", F.lit(False)))
    return signed.groupBy("key_id").agg(F.count(F.lit(1)).alias("certificates"), F.countDistinct("certificate_hash").alias("distinct_certificates"))


def utc(text: Column) -> Column:
    """A timestamp text in either spelling of UTC; null if it is none."""
    return F.when(text.rlike(r"(Z|\+00:00)\z"), F.try_to_timestamp(F.regexp_replace(text, r"Z\z", "+00:00")))


def key_windows(entries: DataFrame, manifests: DataFrame) -> DataFrame:
    """Signed entries by state of the key: inside its window, before, after, or key unknown.

    A key may have several manifests; a signature is inside if any of them covers it.  Manifests
    are few (one row per key and version), so the plan broadcasts them if statistics allow.
    """
    signed = entries.filter(F.coalesce(F.col("certificate_hash") != "", F.lit(False))).select("key_id", utc(F.col("timestamp")).alias("at"))
    perkey = manifests.select("key_id", F.struct(utc(F.col("valid_from")).alias("a"), utc(F.col("valid_until")).alias("b")).alias("w")).groupBy("key_id").agg(F.collect_set("w").alias("windows"))
    joined = signed.join(perkey, "key_id", "left")
    inside = F.exists("windows", lambda w: F.coalesce(w["a"] <= F.col("at"), F.lit(True)) & F.coalesce(F.col("at") <= w["b"], F.lit(True)))
    early = F.forall("windows", lambda w: F.coalesce(F.col("at") < w["a"], F.lit(False)))
    state = F.when(F.col("windows").isNull(), "UNKNOWN_KEY").when(F.col("at").isNull(), "NO_TIME").when(inside, "VALID").when(early, "BEFORE").otherwise("AFTER")
    return joined.groupBy("key_id", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def revocations(entries: DataFrame, revoked: DataFrame) -> DataFrame:
    """Per revoked key: certificates and those made at or after the earliest revocation."""
    first = revoked.groupBy("key_id").agg(F.min("revoked_at").alias("revoked_at"))
    signed = entries.filter(F.coalesce(F.col("certificate_hash") != "", F.lit(False))).select("key_id", "timestamp")
    return signed.join(first, "key_id").groupBy("key_id", "revoked_at").agg(F.count(F.lit(1)).alias("certificates"), F.count(F.when(F.col("timestamp") >= F.col("revoked_at"), 1)).alias("after_revocation"))


def overview(entries: DataFrame) -> DataFrame:
    """One pass, one row: the counts that a report starts with."""
    compliant = F.col("compliance_version").isNotNull()
    return entries.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count(F.when(compliant, 1)).alias("compliance_entries"),
        F.count(F.when(~compliant, 1)).alias("other_entries"),
        F.count("certificate_hash").alias("certificates"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        F.coalesce(F.bool_or("pii_in_log"), F.lit(False)).alias("pii_in_log"),
    )
