"""Audit logs as files: ``audit_YYYY-MM-DD.jsonl``, one entry a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, pattern: str = "audit_*.jsonl") -> DataFrame:
    """``file, line_no, day, raw`` of every non-blank line; ``line_no`` counts from 1.

    A file is one row until it is cut, since only then lines have numbers; daily files are small
    beside a partition.  A folder without such files gives no rows.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    named = files.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    lines = named.select("file", F.posexplode(F.split("value", "\n")).alias("i", "raw"))
    return lines.filter(F.trim("raw") != "").select("file", (F.col("i") + 1).cast("bigint").alias("line_no"), F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})", 1).alias("day"), F.regexp_replace("raw", r"\r\z", "").alias("raw"))


def with_entry(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """``lines`` with ``_entry`` (variant), null for lines that are no JSON object."""
    v = F.expr(f"try_parse_json(`{raw}`)")
    return lines.withColumn("_entry", F.when(F.expr(f"schema_of_variant(try_parse_json(`{raw}`))").startswith("OBJECT"), v))


def last_entry(lines: DataFrame) -> DataFrame:
    """The last line that has ``seq`` and ``entry_hash``: where a writer goes on; no row if none."""
    ok = with_entry(lines).select("file", "line_no", F.try_variant_get("_entry", "$.seq", "bigint").alias("seq"), F.try_variant_get("_entry", "$.entry_hash", "string").alias("entry_hash"))
    return ok.filter(F.col("seq").isNotNull() & F.col("entry_hash").isNotNull()).orderBy(F.desc("file"), F.desc("line_no")).limit(1)


def recovery_point(lines: DataFrame) -> tuple[int, str]:
    """``(next seq, prev_hash)`` for a writer; raises if there are lines but no whole entry, since
    starting anew would hide what was lost."""
    last = last_entry(lines).first()
    if last is not None:
        return last["seq"] + 1, last["entry_hash"]
    if lines.limit(1).count():
        raise ValueError("the log has lines but no whole entry; it cannot be continued")
    return 0, "0" * 64


def write(entries: DataFrame, folder: str, timestamp: str = "timestamp", raw: str = "raw") -> None:
    """Append lines to one folder per day (``day=...``); whole files appear or none do."""
    entries.select(raw, F.substring(timestamp, 1, 10).alias("day")).write.mode("append").partitionBy("day").text(folder)
