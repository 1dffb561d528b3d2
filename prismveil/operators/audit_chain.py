"""Hash-chained audit entries: build, verify and summarise.

An entry names the hash of the entry before it.  Building is a fold in order, one chain at a
time; verifying is row-parallel but for one ``lag``.  To verify one long log, files are checked
inside and stitched at their borders, so that no window spans the log.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismveil.functions.canonical import canonical, entry_hash
from prismveil.sources.audit_log import with_entry

GENESIS = "0" * 64

# Article references by kind of event.
BIAS_EVENTS = ("bias_session_start", "bias_pseudonymise", "bias_finding", "bias_session_end")


def sha256_text(text: Column) -> Column:
    """Hash of a text; the empty text hashes to the empty text."""
    return F.when(text == "", F.lit("")).otherwise(F.sha2(text, 256))


def articles(event_type: Column) -> Column:
    """The articles that an entry of this type is evidence for."""
    base = F.array(F.lit("EU_AI_Act_Art_12"), F.lit("EU_AI_Act_Art_19"))
    return F.when(event_type.isin(*BIAS_EVENTS), F.concat(base, F.array(F.lit("EU_AI_Act_Art_4a")))).when(event_type == "content_generation", F.concat(base, F.array(F.lit("EU_AI_Act_Art_50")))).otherwise(base)


def build(events: DataFrame, chain: str, order: Sequence[str], payload: str) -> DataFrame:
    """``chain, seq, prev_hash, entry_hash`` and ``payload`` of entries chained in ``order``.

    The hash is SHA-256 of the hash before and the payload text.  Rows of one chain are folded by
    one task in batches as they come from the sort, so a chain of any length holds only its last
    hash; chains run in parallel.  Null payloads are empty texts; a null chain is a chain.
    """
    schema = f"`{chain}` {events.schema[chain].dataType.simpleString()}, seq bigint, prev_hash string, entry_hash string, `{payload}` string"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        started, current, seq, prev = False, None, 0, GENESIS
        for b in batches:
            rows = []
            for c, p in zip(b["_c"], b["_p"]):
                if pd.isna(c):
                    c = None
                if not started or c != current:
                    started, current, seq, prev = True, c, 0, GENESIS
                h = hashlib.sha256((prev + (p or "")).encode()).hexdigest()
                rows.append((c, seq, prev, h, p))
                prev, seq = h, seq + 1
            yield pd.DataFrame(rows, columns=[chain, "seq", "prev_hash", "entry_hash", payload])

    slim = events.select(F.col(chain).alias("_c"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(payload).cast("string").alias("_p"))
    return slim.repartition("_c").sortWithinPartitions("_c", *[f"_o{i}" for i in range(len(order))], "_p").mapInPandas(fold, schema)


def broken_links(entries: DataFrame, chain: str, order: Sequence[str], prev_hash: str = "prev_hash", own_hash: str = "entry_hash") -> DataFrame:
    """Entries that do not name the hash before them: ``chain``, order columns, ``expected``,
    ``found``.  The expectation goes on from the stored hash, so one break is one row."""
    w = Window.partitionBy(chain).orderBy(*order)
    linked = entries.select(chain, *order, F.col(prev_hash).alias("found"), F.lag(own_hash, 1, GENESIS).over(w).alias("expected"))
    return linked.filter(~F.col("found").eqNullSafe(F.col("expected"))).select(chain, *order, "expected", "found")


def verify_lines(lines: DataFrame) -> DataFrame:
    """Errors of a log of raw lines: ``file, line_no, seq, error``.

    ``Invalid JSON`` lines are reported and left out of the chain; ``Entry tampered`` where the
    stored hash is not that of the line; ``Chain broken`` where a line does not name the hash of
    the valid line before it, over file borders too.  Hashes come from the raw line, in which an
    absent key is not a null one.
    """

    @F.pandas_udf("string")
    def rehash(raw: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                return entry_hash(json.loads(text))
            except (ValueError, TypeError, RecursionError, AttributeError):
                return None

        return raw.map(one)

    parsed = with_entry(lines)
    bad = parsed.filter(F.col("_entry").isNull()).select("file", "line_no", F.lit(None).cast("bigint").alias("seq"), F.lit("Invalid JSON").alias("error"))
    get = lambda name, kind: F.try_variant_get("_entry", f"$.{name}", kind)
    valid = parsed.filter(F.col("_entry").isNotNull()).select("file", "line_no", get("seq", "bigint").alias("seq"), get("prev_hash", "string").alias("prev"), get("entry_hash", "string").alias("own"), "raw")
    tampered = valid.filter(~rehash("raw").eqNullSafe(F.col("own"))).select("file", "line_no", "seq", F.lit("Entry tampered").alias("error"))
    in_file = Window.partitionBy("file").orderBy("line_no")
    linked = valid.select("file", "line_no", "seq", "prev", F.lag("own").over(in_file).alias("expected"), F.row_number().over(in_file).alias("_n"))
    inside = linked.filter((F.col("_n") > 1) & ~F.col("prev").eqNullSafe(F.col("expected")))
    # one row per file from here on
    ends = valid.groupBy("file").agg(F.min_by(F.struct("line_no", "seq", "prev"), "line_no").alias("a"), F.max_by("own", "line_no").alias("own"))
    borders = ends.select("file", "a.*", F.lag("own", 1, GENESIS).over(Window.orderBy("file")).alias("expected"))
    crossing = borders.filter(~F.col("prev").eqNullSafe(F.col("expected")))
    broken = inside.select("file", "line_no", "seq").unionByName(crossing.select("file", "line_no", "seq")).withColumn("error", F.lit("Chain broken"))
    return bad.unionByName(tampered).unionByName(broken)


def stats(entries: DataFrame) -> DataFrame:
    """One row: events, entities, distinct models and providers, first and last timestamp."""
    return entries.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.coalesce(F.sum("entity_count"), F.lit(0)).alias("total_entities"),
        F.countDistinct("model").alias("n_models"),
        F.countDistinct("provider").alias("n_providers"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
    )


def category_totals(entries: DataFrame, *by: str) -> DataFrame:
    """Sums of the category counts, per ``by``; null counts are none."""
    rows = entries.select(*by, F.explode("categories").alias("category", "n")).filter(F.col("n").isNotNull())
    return rows.groupBy(*by, "category").agg(F.sum("n").alias("n"))


def due_checkpoints(entries: DataFrame, interval: int, seq: str = "seq") -> DataFrame:
    """Entries after which a checkpoint is due; checkpoints themselves are not counted."""
    return entries.filter((F.pmod(F.col(seq) + 1, F.lit(interval)) == 0) & (F.coalesce("event_type", F.lit("")) != "chain_checkpoint"))


def schema_violations(entries: DataFrame) -> DataFrame:
    """``entries`` with ``violations``: what a typed entry breaks of the rules for entries."""
    rules = {
        "decision_id": F.col("decision_id").isNotNull() & ~F.col("decision_id").rlike(r"\A[\x20-\x7E]{1,64}\z"),
        "seq": F.col("seq").isNull() | (F.col("seq") < 0),
        "entity_count": F.col("entity_count") < 0,
        "entry_hash": F.col("entry_hash").isNull() | ~F.col("entry_hash").rlike(r"\A[0-9a-f]{64}\z"),
        "prev_hash": F.col("prev_hash").isNull() | ~F.col("prev_hash").rlike(r"\A[0-9a-f]{64}\z"),
        "timestamp": F.col("timestamp").isNull() | (F.col("timestamp") == ""),
        "bias_context": F.col("event_type").isin(*BIAS_EVENTS) & F.col("bias_context").isNull(),
        "content_context": (F.col("event_type") == "content_generation") & F.col("content_context").isNull(),
        "checkpoint_context": (F.col("event_type") == "chain_checkpoint") & F.col("checkpoint_context").isNull(),
        "retention_hint_days": F.col("retention_hint_days") < 1,
    }
    found = F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()])
    return entries.withColumn("violations", F.filter(found, lambda v: v.isNotNull()))


__all__ = ["GENESIS", "articles", "broken_links", "build", "canonical", "category_totals", "due_checkpoints", "schema_violations", "sha256_text", "stats", "verify_lines"]
