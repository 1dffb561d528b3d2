"""Schemas that drift between files: a catalogue of column lifespans.

1. Every file is reduced to *footer metadata*: which top-level fields it has, in which JSON
   types, on how many lines.  Counts combine map-side; after this step sizes follow the
   number of files and fields, not the number of lines.
2. ``lag`` carries the last known type over files in which a field has only nulls; then the
   islands of consecutive files in which a producer's field has one type are its *lifespans*
   (first and last file).  Their starts and endings are the log.
3. Starts and endings that meet in one file under one canonical name (the alias table, an
   argument) are a renaming; those that meet unpaired are listed as candidates with evidence.
4. The same alias table generates the casts of the one consistent table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismveil.plans.storage import materialise

# Fixed values, the default alias table (its source: the spellings met in test lines and the
# names of the audit schema; give another to every operator here): canonical field -> (type in the consistent table, other spellings met so far).
# Spellings that differ only in case and underscores are recognised without being listed.
ALIASES: dict[str, tuple[str, tuple[str, ...]]] = {
    "seq": ("bigint", ()),
    "event_id": ("string", ()),
    "timestamp": ("string", ()),
    "event_type": ("string", ("kind", "type")),
    "model": ("string", ("model_name", "modelId")),
    "provider": ("string", ("provider_name", "vendor")),
    "entity_count": ("bigint", ("n_entities",)),
    "categories": ("json", ("category_counts",)),
    "tokens_used": ("json", ("tokens",)),
    "prompt_hash": ("string", ("prompt_sha256",)),
    "sanitized_hash": ("string", ()),
    "latency_ms": ("double", ("latency", "elapsed_ms")),
    "mode": ("string", ("tokenize_mode",)),
    "entity_details": ("json", ()),
    "timing": ("json", ()),
    "certificate_hash": ("string", ()),
    "key_id": ("string", ("signing_key",)),
    "prev_hash": ("string", ()),
    "metadata": ("json", ("meta",)),
    "risk_assessment": ("json", ()),
    "bias_context": ("json", ()),
    "decision_id": ("string", ("decision", "decision_ref", "decisionULID")),
    "system_version_pin": ("string", ("sys_version_pin", "version_pin", "model_pin")),
    "key_manifest": ("json", ()),
    "content_context": ("json", ()),
    "checkpoint_context": ("json", ()),
    "compliance_version": ("string", ("compliance_ver", "comp_version", "compliance_schema")),
    "article_ref": ("json", ("articles",)),
    "retention_hint_days": ("bigint", ("retention_days",)),
    "pii_in_log": ("boolean", ()),
    "entry_hash": ("string", ()),
    "trace_id": ("string", ()),
    "sdk_build": ("string", ()),
}

#: first letters of ``schema_of_variant`` -> JSON type; null is no type
_JSON_TYPES = {
    "string": ("STRING",),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT"),
}


def folded(name: str) -> str:
    """A field name without case and underscores."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def spellings(aliases: dict[str, tuple[str, tuple[str, ...]]] = ALIASES) -> dict[str, str]:
    """Folded spelling -> canonical field."""
    return {folded(s): canon for canon, (_, others) in aliases.items() for s in (canon, *others)}


def canonical(name: Column, aliases: dict[str, tuple[str, tuple[str, ...]]] = ALIASES) -> Column:
    """Canonical field of a field name; an unknown field stands for its folded spelling."""
    pairs = [F.lit(x) for kv in spellings(aliases).items() for x in kv]
    fold = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    return F.coalesce(F.try_element_at(F.create_map(*pairs), fold), F.when(fold != "", fold), name)


def _json_type(schema: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, heads in _JSON_TYPES.items():
        out = F.when(schema.rlike("^(" + "|".join(heads) + ")"), F.lit(kind)).otherwise(out)
    return out


def parsed(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """``lines`` with ``_fields``: the top-level fields as a map of variants, null if the
    line is no JSON object.  Of a repeated key the last value counts, as in most parsers; the
    session is set to read such objects, since the setting may be read as late as planning."""
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return lines.withColumn("_fields", F.expr(f"try_variant_get(try_parse_json(`{raw}`), '$', 'map<string,variant>')"))


def footers(lines: DataFrame, chain: str = "chain_id", file: str = "file_name", order: str = "line_no", raw: str = "raw") -> DataFrame:
    """Footer metadata: ``chain, file, field, json_type, n_lines``, one row per file and field.

    ``json_type`` is the type on the last line that has one.  A file without any JSON
    object gives one row with a null ``field``, so that it still counts as a file.
    """
    types = F.expr("transform(map_entries(_fields), e -> struct(e.key AS k, schema_of_variant(e.value) AS t))")
    exploded = (
        parsed(lines, raw)
        .select(F.col(chain).alias("chain"), F.col(file).alias("file"), F.col(order).alias("_o"), types.alias("_kt"))
        .select("chain", "file", "_o", F.explode_outer("_kt").alias("_kt"))
        .select("chain", "file", "_o", F.col("_kt.k").alias("field"), _json_type(F.col("_kt.t")).alias("_t"))
    )
    return (
        exploded.groupBy("chain", "file", "field")
        .agg(
            F.max(F.when(F.col("_t").isNotNull(), F.struct(F.coalesce("_o", F.lit(-1)).alias("o"), F.col("_t").alias("t")))).alias("_last"),
            F.count(F.lit(1)).alias("n_lines"),
        )
        .select("chain", "file", "field", F.col("_last.t").alias("json_type"), "n_lines")
    )


Aliases = dict[str, tuple[str, tuple[str, ...]]]


def lives(catalogue: DataFrame, aliases: Aliases = ALIASES) -> DataFrame:
    """The catalogue with file numbers, canonical names and types carried over files with nulls.

    Files are numbered from the distinct pairs of producer and file, so the window of a hot
    producer holds one slim row per file.  ``type`` is the file's own, else the one that the
    field, else that its canonical name had last; ``was`` is the type before, ``canon_name`` and
    ``canon_ord`` the name and file of the canonical field before.
    """
    by_chain = Window.partitionBy("chain").orderBy("file")
    files = catalogue.select("chain", "file").distinct()
    files = files.select(F.col("chain").alias("_c"), F.col("file").alias("_f"), F.row_number().over(by_chain).alias("ord"), F.lead("file").over(by_chain).alias("next_file"))
    numbered = (
        catalogue.filter(F.col("field").isNotNull())
        .join(files, F.col("chain").eqNullSafe(F.col("_c")) & F.col("file").eqNullSafe(F.col("_f")))
        .drop("_c", "_f")
        .withColumn("canon", canonical(F.col("field"), aliases))
    )
    own = Window.partitionBy("chain", "field").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    named = Window.partitionBy("chain", "canon").orderBy("ord", "field")
    return (
        numbered.withColumn("own_type", F.last("json_type", ignorenulls=True).over(own))
        .withColumn("canon_type", F.last("json_type", ignorenulls=True).over(named.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("canon_ord", F.lag("ord").over(named))
        .withColumn("canon_name", F.lag("field").over(named))
        .withColumn("prev_ord", F.lag("ord").over(Window.partitionBy("chain", "field").orderBy("ord")))
        .withColumn("type", F.coalesce("json_type", "own_type", "canon_type"))
    )


def lifespans(life: DataFrame) -> DataFrame:
    """``chain, canon, field, type, first_ord, last_ord, first_file, last_file, n_files, n_lines``
    and ``next_file`` after the last: the islands of consecutive files of one type."""
    run = F.col("ord") - F.row_number().over(Window.partitionBy("chain", "field", "type").orderBy("ord"))
    return (
        life.withColumn("_island", run)
        .groupBy("chain", "canon", "field", "type", "_island")
        .agg(
            F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.min("file").alias("first_file"), F.max("file").alias("last_file"),
            F.count(F.lit(1)).alias("n_files"), F.sum("n_lines").alias("n_lines"), F.max_by("next_file", "ord").alias("next_file"),
        )
        .drop("_island")
    )


def _events(spans: DataFrame) -> DataFrame:
    """Starts (``added``) and endings (``removed``) of fields, at the file in which they show."""
    own = Window.partitionBy("chain", "field").orderBy("first_ord")
    near = spans.withColumn("_before", F.lag("last_ord").over(own)).withColumn("_after", F.lead("first_ord").over(own))
    starts = near.filter((F.col("first_ord") > 1) & ~F.coalesce(F.col("_before") == F.col("first_ord") - 1, F.lit(False)))
    ends = near.filter(F.col("next_file").isNotNull() & ~F.coalesce(F.col("_after") == F.col("last_ord") + 1, F.lit(False)))
    return starts.select("chain", F.col("first_file").alias("file"), "canon", "field", "type", F.lit("added").alias("kind")).unionByName(
        ends.select("chain", F.col("next_file").alias("file"), "canon", "field", "type", F.lit("removed").alias("kind"))
    )


def changes(lines: DataFrame, aliases: Aliases = ALIASES, **names: str) -> DataFrame:
    """Every change of a top-level field between neighbouring files of one chain.

    Columns: ``chain_id, file_name, field_name, change_kind`` with ``added``, ``removed``,
    ``renamed`` and ``retyped``; the first file of a chain has none.  A renamed field gives
    one ``renamed`` row (its earlier name) and, if its type changed too, one ``retyped`` row.

    Defined results: lines that are null, empty or no JSON object carry no field; repeated
    lines change nothing; a null chain is a chain; files are ordered by name; a field with
    only nulls has no type and keeps the one it last had; an empty table has no changes.
    """
    catalogue = materialise(footers(lines, **names), "drift-footers")
    life = materialise(lives(catalogue, aliases), "drift-lives")
    met = (
        _events(lifespans(life))
        .groupBy("chain", "file", "canon")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("kind") == "added", F.col("field")))).alias("a"),
            F.array_sort(F.collect_set(F.when(F.col("kind") == "removed", F.col("field")))).alias("r"),
        )
    )
    pairs = F.least(F.size("a"), F.size("r"))
    log = met.select(
        "chain",
        "file",
        F.explode(
            F.concat(
                F.transform("r", lambda x, i: F.struct(x.alias("field"), F.when(i < pairs, F.lit("renamed")).otherwise(F.lit("removed")).alias("kind"))),
                F.transform(F.filter("a", lambda x, i: i >= pairs), lambda x: F.struct(x.alias("field"), F.lit("added").alias("kind"))),
            )
        ).alias("c"),
    ).select("chain", "file", "c.field", "c.kind")
    # an island that follows another of its field, or of its canonical name, at once
    follows = F.coalesce(F.col("prev_ord") == F.col("ord") - 1, F.lit(False))
    was = F.when(follows, F.coalesce("own_type", "canon_type")).when(F.col("canon_ord") == F.col("ord") - 1, F.col("canon_type"))
    name = F.when(follows, F.col("field")).otherwise(F.col("canon_name"))
    retyped = life.filter(F.col("json_type").isNotNull() & (was != F.col("json_type"))).select("chain", "file", name.alias("field"), F.lit("retyped").alias("kind"))
    return (
        log.unionByName(retyped)
        .select(F.col("chain").alias("chain_id"), F.col("file").alias("file_name"), F.col("field").alias("field_name"), F.col("kind").alias("change_kind"))
        .distinct()
    )


def rename_candidates(lines: DataFrame, aliases: Aliases = ALIASES, **names: str) -> DataFrame:
    """Starts and endings that meet in one file with one type but under names that no alias joins:
    ``removed_name, added_name, json_type, n_meetings, n_files_shared``.

    Evidence: in how many files they met, and in how many files both names live (a renaming has
    none).  Pairs are of fields of one file, whose number is bounded by the fields of a record.
    """
    life = materialise(lives(materialise(footers(lines, **names), "drift-footers"), aliases), "drift-lives")
    ev = _events(lifespans(life))
    a = ev.filter("kind = 'added'").select("chain", "file", "type", F.col("field").alias("added_name"), F.col("canon").alias("_ca"))
    r = ev.filter("kind = 'removed'").select("chain", "file", "type", F.col("field").alias("removed_name"), F.col("canon").alias("_cr"))
    met = a.join(r, ["chain", "file", "type"]).filter(F.col("_ca") != F.col("_cr"))
    found = met.groupBy("removed_name", "added_name", F.col("type").alias("json_type")).agg(F.count(F.lit(1)).alias("n_meetings"))
    lived = life.select("chain", "file", "field")
    both = (
        found.select("removed_name", "added_name").distinct().join(lived.withColumnRenamed("field", "removed_name"), "removed_name")
        .join(lived.withColumnRenamed("field", "added_name"), ["chain", "file", "added_name"])
        .groupBy("removed_name", "added_name").agg(F.count(F.lit(1)).alias("n_files_shared"))
    )
    return found.join(both, ["removed_name", "added_name"], "left").fillna(0, ["n_files_shared"])


def _cast(variant: Column, target: str) -> Column:
    text = F.coalesce(F.try_variant_get(variant, "$", "string"), F.to_json(variant))
    if target == "json":
        return F.to_json(variant)
    if target == "string":
        return text
    if target == "bigint":
        return F.coalesce(F.try_variant_get(variant, "$", "bigint"), text.try_cast("double").try_cast("bigint"))
    if target == "double":
        return F.coalesce(F.try_variant_get(variant, "$", "double"), text.try_cast("double"))
    if target == "boolean":
        return F.coalesce(
            F.try_variant_get(variant, "$", "boolean"),
            F.when(F.lower(text).isin("true", "1", "yes"), True).when(F.lower(text).isin("false", "0", "no"), False),
        )
    raise ValueError(f"no cast to {target}")


def consistent_table(lines: DataFrame, aliases: dict[str, tuple[str, tuple[str, ...]]] = ALIASES, raw: str = "raw") -> DataFrame:
    """All JSON-object lines as one table with the canonical columns.

    Casts are generated from the alias table: a column is the first non-null spelling, cast
    to its one type; what cannot be cast is null.  Fields in no alias entry stay together,
    under their own names and as JSON text, in ``unknown_fields``.  Columns of ``lines`` are kept
    (they win over fields of the same name, which then are prefixed with ``entry_``; names that
    start with ``_`` are left out).  Lines that are null or no JSON object have no row.
    """
    known = spellings(aliases)
    lines = lines.select(*[c for c in lines.columns if not c.startswith("_")])
    rows = parsed(lines, raw).filter(F.col("_fields").isNotNull())
    # two spellings that fold to one name on a line: the first that is not null decides
    rows = rows.withColumn("_set", F.expr("filter(map_entries(_fields), e -> NOT is_variant_null(e.value))"))
    fold = "regexp_replace(lower({}), '[^a-z0-9]', '')"
    names_set = f"array_distinct(transform(_set, e -> {fold.format('e.key')}))"
    rows = rows.withColumn("_by", F.map_from_entries(F.expr(f"transform({names_set}, f -> struct(f, get(filter(_set, e -> {fold.format('e.key')} = f), 0).value))")))
    out: list[Column] = [F.col(c) for c in lines.columns if c != raw]
    for canon, (target, others) in aliases.items():
        names = list(dict.fromkeys(folded(s) for s in (canon, *others)))
        value = F.coalesce(*[_cast(F.try_element_at("_by", F.lit(n)), target) for n in names])
        out.append(value.alias(f"entry_{canon}" if canon in lines.columns else canon))
    rest = F.map_filter("_fields", lambda k, _: ~F.regexp_replace(F.lower(k), "[^a-z0-9]", "").isin(*known))
    out.append(F.when(F.size(rest) > 0, F.to_json(rest)).alias("entry_unknown_fields" if "unknown_fields" in lines.columns else "unknown_fields"))
    return rows.select(*out)
