"""Queries of the general training-data problems: drift, nesting, increments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismveil.operators import incremental, schema_drift, shredding
from prismveil.plans.storage import materialise, shared_dir, table

LATEST = ("delivery_no", "received_at", "entry_hash")
NESTED = ("entity_details", "categories", "timing", "bias_context")
ENTITY_FIELDS = {
    "category": "string", "start": "int", "end": "int", "length": "int", "confidence": "double",
    "source": "string", "token": "string", "entity_hash": "string", "text_index": "int",
}
BIAS_FIELDS = {
    "session_id": "string", "purpose": "string", "necessity_justification": "string", "max_lifetime_seconds": "bigint",
    "entity_count": "bigint", "exit_reason": "string", "wipe_confirmed": "boolean", "entries_processed": "bigint",
    "duration_seconds": "double", "finding_summary": "string", "bias_metrics": "string",
}
TYPED = ("entity_details", "categories", "timing", "bias_context.categories_allowed", "bias_context.categories_used")


# ---- 3: schemas that drift -------------------------------------------------------------


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of a top-level field of audit_lines."""
    return schema_drift.changes(table(spark, sf, "audit_lines"))


def p3_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Footer metadata: fields of every file with the number of lines that carry them."""
    f = schema_drift.footers(table(spark, sf, "audit_lines"))
    return f.filter(F.col("field").isNotNull()).select(F.col("chain").alias("chain_id"), F.col("file").alias("file_name"), F.col("field").alias("field_name"), "json_type", "n_lines")


def p3_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    """First and last file of every field of a chain in one type."""
    life = schema_drift.lives(materialise(schema_drift.footers(table(spark, sf, "audit_lines")), "drift-footers"))
    return schema_drift.lifespans(life).select(F.col("chain").alias("chain_id"), "field", "canon", "type", "first_file", "last_file", "n_files", "n_lines")


def p3_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Changes that may be renamings unknown to the alias table, with evidence."""
    return schema_drift.rename_candidates(table(spark, sf, "audit_lines"))


def p3_table(spark: SparkSession, sf: str) -> DataFrame:
    """The one consistent table of all entries in audit_lines."""
    return schema_drift.consistent_table(table(spark, sf, "audit_lines"))


# ---- 4: nested records -----------------------------------------------------------------


def _both(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    parts = [table(spark, sf, t).select("event_id", *LATEST, *columns) for t in ("audit_chain_py", "audit_chain_bias_py")]
    return parts[0].unionByName(parts[1])


def _latest(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return incremental.latest_rows(_both(spark, sf, *columns), "event_id", LATEST)


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The stored adjacency table of the last delivered rows, JSON text included.

    The text of bias_metrics is the scalar ``$.bias_context.bias_metrics``; what it parses to
    lies below ``$.bias_metrics``.  Each audit table is scanned once.
    """
    typed = materialise(shredding.node_table(_latest(spark, sf, *NESTED), "event_id", NESTED), "p4-nodes")
    return typed.unionByName(materialise(_parsed(typed), "p4-json-nodes"))


def _parsed(typed: DataFrame) -> DataFrame:
    texts = typed.filter(F.col("node") == "$.bias_context.bias_metrics").select("event_id", "scalar")
    return shredding.json_node_table(texts, "event_id", "scalar", "bias_metrics")


def _json_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The adjacency table of the parsed bias_metrics, below ``$.bias_metrics``."""
    return _parsed(shredding.node_table(_latest(spark, sf, "bias_context"), "event_id", ("bias_context",)))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Child records of the last delivered row of each entry, with their way back."""
    nodes = _nodes(spark, sf)
    details = shredding.entity_table(nodes, "event_id", "entity_details", tuple(ENTITY_FIELDS))
    parts = [details.select("event_id", F.lit("entity_details").alias("child_table"), F.col("ordinal").cast("string").alias("child_key"))]
    for column in TYPED[1:]:
        rows = shredding.value_table(nodes, "event_id", column)
        parts.append(rows.select("event_id", F.lit(column.rsplit(".", 1)[-1]).alias("child_table"), F.coalesce("label", F.col("ordinal").cast("string")).alias("child_key")))
    parts.append(shredding.grouped_metrics(nodes.filter(shredding.below(F.col("node"), "bias_metrics")), "event_id", "bias_metrics"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def p4_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The adjacency table of the nested columns of the last delivered rows, JSON text included."""
    return _nodes(spark, sf)


def p4_entity_details(spark: SparkSession, sf: str) -> DataFrame:
    """The entity table of entity_details, one row per element, linked by event_id."""
    last = incremental.latest_rows(_both(spark, sf, "entity_details"), "event_id", LATEST)
    nodes = shredding.node_table(last, "event_id", ("entity_details",))
    fields = ("category", "start", "end", "source", "token")
    wide = shredding.entity_table(nodes, "event_id", "entity_details", fields)
    return wide.select(
        "event_id",
        F.col("ordinal").alias("position"),
        "category",
        F.col("start").cast("int").alias("span_start"),
        F.col("end").cast("int").alias("span_end"),
        F.col("source").alias("detector"),
        "token",
    )


def p4_entity_details_all(spark: SparkSession, sf: str) -> DataFrame:
    """The entity table of entity_details with all its fields."""
    nodes = shredding.node_table(_latest(spark, sf, "entity_details"), "event_id", ("entity_details",))
    wide = shredding.entity_table(nodes, "event_id", "entity_details", tuple(ENTITY_FIELDS))
    names = {"start": "span_start", "end": "span_end", "source": "detector"}
    return wide.select(
        "event_id",
        F.col("ordinal").alias("position"),
        *[F.col(f).cast(t).alias(names.get(f, f)) for f, t in ENTITY_FIELDS.items()],
    )


def _values(spark: SparkSession, sf: str, column: str) -> DataFrame:
    nodes = shredding.node_table(_latest(spark, sf, column.split(".")[0]), "event_id", (column,))
    return shredding.value_table(nodes, "event_id", column)


def p4_timing(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of timing with their values."""
    return _values(spark, sf, "timing").select("event_id", F.col("label").alias("step"), F.col("scalar").cast("double").alias("value"))


def p4_categories(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of categories with their counts."""
    return _values(spark, sf, "categories").select("event_id", F.col("label").alias("category"), F.col("scalar").cast("bigint").alias("n"))


def p4_categories_used(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of bias_context.categories_used with their counts."""
    rows = _values(spark, sf, "bias_context.categories_used")
    return rows.select("event_id", F.col("label").alias("category"), F.col("scalar").cast("bigint").alias("n"))


def p4_categories_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """The elements of bias_context.categories_allowed with their positions."""
    rows = _values(spark, sf, "bias_context.categories_allowed")
    return rows.select("event_id", F.col("ordinal").alias("position"), F.col("scalar").alias("category"))


def p4_bias_context(spark: SparkSession, sf: str) -> DataFrame:
    """The scalar fields of bias_context, one row per context."""
    nodes = shredding.node_table(_latest(spark, sf, "bias_context"), "event_id", ("bias_context",))
    wide = shredding.record_table(nodes, "event_id", "bias_context", tuple(BIAS_FIELDS))
    return wide.select("event_id", *[F.col(f).cast(t).alias(f) for f, t in BIAS_FIELDS.items()])


def p4_bias_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The scalar fields on the first level of the parsed bias_metrics, as text."""
    return shredding.value_table(_json_nodes(spark, sf), "event_id", "bias_metrics").select("event_id", F.col("label").alias("field"), F.col("scalar").alias("value"))


def p4_bias_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The groups of bias_metrics with their size and interval."""
    rows = shredding.group_table(materialise(_json_nodes(spark, sf), "p4-json-nodes"), "event_id", "bias_metrics")
    return rows.select(
        "event_id", "node", F.col("group").alias("group_name"), F.expr("try_cast(n as bigint)").alias("n"),
        F.expr("try_cast(ci_lo as double)").alias("ci_lo"), F.expr("try_cast(ci_hi as double)").alias("ci_hi"),
    )


def p4_bias_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics of the groups of bias_metrics with their values."""
    rows = shredding.metric_table(materialise(_json_nodes(spark, sf), "p4-json-nodes"), "event_id", "bias_metrics")
    return rows.select("event_id", "node", F.col("group").alias("group_name"), "metric", F.expr("try_cast(value as double)").alias("value"))


# ---- 5: increments ---------------------------------------------------------------------


def _processed(spark: SparkSession, sf: str) -> tuple[DataFrame, str, str]:
    """The slim rows of audit_chain_py, and what its succeeded runs left behind: the forms they
    processed and the fingerprints recorded with them."""
    rows = table(spark, sf, "audit_chain_py").select("event_id", "entry_hash", "delivery_no", "received_at")
    done = table(spark, sf, "ingest_runs").filter("status = 'succeeded'").select("delivery_no").distinct()
    base = f"{shared_dir(spark)}/p5-{uuid.uuid4().hex}"
    target, state = f"{base}/forms", f"{base}/fingerprints"
    incremental.process_increment(rows.join(done, "delivery_no", "left_semi"), target, state, ["delivery_no"], ["event_id", "entry_hash"], lambda df: df.distinct())
    return rows, target, state


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose current form no succeeded delivery holds."""
    return incremental.pending_entries(*_processed(spark, sf))


def p5_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries whose fingerprint is not recorded, with their row counts."""
    rows, _, state = _processed(spark, sf)
    now = incremental.fingerprints(rows, ["delivery_no"], ["event_id", "entry_hash"])
    recorded, _ = incremental.latest_records(spark, state, ["delivery_no"], now)
    return now.join(incremental.changed_partitions(now, recorded, ["delivery_no"]), "delivery_no", "left_semi").select("delivery_no", "n_rows")


QUERIES = {f.__name__: f for f in (p3_found, p3_catalogue, p3_lifespans, p3_candidates, p3_table, p4_found, p4_nodes, p4_entity_details, p4_entity_details_all, p4_timing, p4_categories, p4_categories_used, p4_categories_allowed, p4_bias_context, p4_bias_totals, p4_bias_groups, p4_bias_metrics, p5_found, p5_partitions)}

_LAST = """(SELECT * FROM (SELECT {cols}, row_number() OVER (PARTITION BY event_id
    ORDER BY delivery_no DESC, received_at DESC, entry_hash DESC) AS rn FROM (
    SELECT {cols}, delivery_no, received_at, entry_hash FROM audit_chain_py UNION ALL
    SELECT {cols}, delivery_no, received_at, entry_hash FROM audit_chain_bias_py)) WHERE rn = 1)"""

ORACLES = {
    "p4_entity_details": f"""
        SELECT event_id, CAST(i - 1 AS INTEGER) AS position, d.category AS category, d.start AS span_start,
               d."end" AS span_end, d.source AS detector, d.token AS token
        FROM (SELECT event_id, unnest(entity_details) AS d, unnest(range(1, len(entity_details) + 1)) AS i
              FROM {_LAST.format(cols="event_id, entity_details")})
        WHERE d IS NOT NULL""",
    "p4_entity_details_all": f"""
        SELECT event_id, CAST(i - 1 AS INTEGER) AS position, d.category AS category, d.start AS span_start,
               d."end" AS span_end, d.length AS length, d.confidence AS confidence, d.source AS detector, d.token AS token,
               d.entity_hash AS entity_hash, d.text_index AS text_index
        FROM (SELECT event_id, unnest(entity_details) AS d, unnest(range(1, len(entity_details) + 1)) AS i
              FROM {_LAST.format(cols="event_id, entity_details")})
        WHERE d IS NOT NULL""",
    "p4_timing": f"""
        SELECT event_id, e.key AS step, e.value AS value
        FROM (SELECT event_id, unnest(map_entries(timing)) AS e FROM {_LAST.format(cols="event_id, timing")})
        WHERE e.value IS NOT NULL""",
    "p4_categories": f"""
        SELECT event_id, e.key AS category, e.value AS n
        FROM (SELECT event_id, unnest(map_entries(categories)) AS e FROM {_LAST.format(cols="event_id, categories")})
        WHERE e.value IS NOT NULL""",
    "p4_categories_used": f"""
        SELECT event_id, e.key AS category, e.value AS n
        FROM (SELECT event_id, unnest(map_entries(bias_context.categories_used)) AS e FROM {_LAST.format(cols="event_id, bias_context")})
        WHERE e.value IS NOT NULL""",
    "p4_categories_allowed": f"""
        SELECT event_id, CAST(i - 1 AS INTEGER) AS position, c AS category
        FROM (SELECT event_id, unnest(bias_context.categories_allowed) AS c, unnest(range(1, len(bias_context.categories_allowed) + 1)) AS i
              FROM {_LAST.format(cols="event_id, bias_context")})
        WHERE c IS NOT NULL""",
    "p4_bias_context": f"""
        SELECT event_id, {", ".join(f"bias_context.{c} AS {c}" for c in BIAS_FIELDS)}
        FROM {_LAST.format(cols="event_id, bias_context")} WHERE bias_context IS NOT NULL""",
    "p5_found": """
        WITH ok AS (SELECT DISTINCT delivery_no FROM ingest_runs WHERE status = 'succeeded'),
        held AS (SELECT DISTINCT event_id, entry_hash FROM audit_chain_py WHERE delivery_no IN (SELECT delivery_no FROM ok)),
        cur AS (SELECT event_id, entry_hash FROM (SELECT event_id, entry_hash, row_number() OVER (PARTITION BY event_id
            ORDER BY delivery_no DESC, received_at DESC, entry_hash DESC) AS rn FROM audit_chain_py) WHERE rn = 1)
        SELECT event_id, entry_hash, CASE WHEN event_id IN (SELECT event_id FROM held) THEN 'changed' ELSE 'new' END AS change_kind
        FROM cur WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.event_id = cur.event_id AND held.entry_hash = cur.entry_hash)""",
    "p5_partitions": """
        SELECT delivery_no, count(*) AS n_rows FROM audit_chain_py
        WHERE delivery_no NOT IN (SELECT delivery_no FROM ingest_runs WHERE status = 'succeeded') GROUP BY delivery_no""",
    "p3_catalogue": """
        SELECT chain_id, file_name, field_name, max_by(t, line_no) FILTER (WHERE t IS NOT NULL) AS json_type, count(*) AS n_lines FROM (
          SELECT chain_id, file_name, line_no, k AS field_name, CASE json_type(raw, '$."' || k || '"')
            WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array'
            WHEN 'NULL' THEN NULL ELSE 'number' END AS t
          FROM (SELECT chain_id, file_name, line_no, raw, unnest(json_keys(raw)) AS k FROM audit_lines
                WHERE json_valid(raw) AND json_type(raw) = 'OBJECT'))
        GROUP BY chain_id, file_name, field_name""",
}
