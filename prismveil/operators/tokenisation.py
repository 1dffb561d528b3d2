"""Spans replaced by tokens such as ``[EMAIL_0]``, and tokens replaced by their values.

Numbers run from right to left inside a text: the last span of a text is replaced first and
gets the least number.  A value (trimmed) has one token in its scope, whatever category it is
found under later; the category seen first owns it.  A scope is a text, a batch or a
conversation.  Per-text scopes are done inside the batch that detects; wider scopes number the
table of detections with two windows and splice with expressions, so no scope is collected.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismveil.functions.categories import ESCAPED_CLOSE, ESCAPED_OPEN, TOKEN_PATTERN
from prismveil.operators.detection import Detection, Engine

_TOKEN = re.compile(TOKEN_PATTERN, re.A)
_ESCAPED = re.compile(f"{ESCAPED_OPEN}([A-Z][A-Z0-9_]*_(?:\\d+|REDACTED)){ESCAPED_CLOSE}", re.A)

# Fixed value: three-digit ZIP areas of at most 20,000 people (Census 2000).
SMALL_ZIP3 = tuple("036 059 063 102 203 556 692 790 821 823 830 831 878 879 884 890 893".split())


# ---- expressions -------------------------------------------------------------------------


def escape_tokens(text: Column) -> Column:
    """Tokens that stand in a text already, in full-width brackets, so that nothing restores them."""
    return F.regexp_replace(text, r"\[([A-Z][A-Z0-9_]*_(?:[0-9]+|REDACTED))\]", f"{ESCAPED_OPEN}$1{ESCAPED_CLOSE}")


def unescape_tokens(text: Column) -> Column:
    return F.regexp_replace(text, f"{ESCAPED_OPEN}([A-Z][A-Z0-9_]*_(?:[0-9]+|REDACTED)){ESCAPED_CLOSE}", r"\[$1\]")


def generalized_date(value: Column) -> Column:
    """The year of a date, or ``[DATE_REDACTED]``."""
    year = F.regexp_extract(value, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1)
    return F.when(value.isNotNull(), F.coalesce(F.nullif(year, F.lit("")), F.lit("[DATE_REDACTED]")))


def generalized_age(value: Column) -> Column:
    """``90+`` in place of the first number, or ``aged 90+``."""
    return F.when(value.rlike("[0-9]"), F.regexp_replace(value, r"\A([^0-9]*)[0-9]+", "$190+")).otherwise(F.when(value.isNotNull(), F.lit("aged 90+")))


def zip3(value: Column, small: Sequence[str] = SMALL_ZIP3) -> Column:
    head = F.substring(value, 1, 3)
    return F.concat(F.when(head.isin(*small), F.lit("000")).otherwise(head), F.lit("XX"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex, from two ``sha2`` over padded key bytes."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytearray(b ^ p for b in block) for p in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))), 256)


def entity_hash(key: bytes, category: Column, value: Column) -> Column:
    """Keyed hash of ``CATEGORY:value`` with the value trimmed and in lower case."""
    return hmac_sha256(key, F.concat(category, F.lit(":"), F.lower(F.trim(value))))


# ---- one text ------------------------------------------------------------------------------


@dataclass
class TokenMap:
    """Values and tokens of one scope; may serve any number of texts, in order."""

    mode: str = "tokenize"
    forward: dict[str, str] = field(default_factory=dict)
    reverse: dict[str, str] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    categories: dict[str, int] = field(default_factory=dict)
    details: list[dict] = field(default_factory=list)

    def token(self, value: str, category: str) -> str:
        self.categories[category] = self.categories.get(category, 0) + 1
        if self.mode == "redact":
            return f"[{category}_REDACTED]"
        value = value.strip()
        if value not in self.forward:
            n = self.counters.get(category, 0)
            self.counters[category] = n + 1
            self.forward[value] = f"[{category}_{n}]"
            self.reverse[self.forward[value]] = value
        return self.forward[value]

    def summary(self) -> dict:
        return {"entity_count": len(self.forward), "categories": dict(self.categories), "tokens": sorted(self.reverse), "mode": self.mode}


def generalized(category: str, value: str) -> str | None:
    """Safe replacement of a date, an age or a ZIP code; None for other categories."""
    if category == "DATE":
        m = re.search(r"(?<!\d)((?:19|20)\d{2})(?!\d)", value)
        return m.group(1) if m else "[DATE_REDACTED]"
    if category == "AGE_90PLUS":
        return re.sub(r"\d+", "90+", value, count=1) if re.search(r"\d", value) else "aged 90+"
    if category == "ZIP":
        return ("000" if value[:3] in SMALL_ZIP3 else value[:3]) + "XX"
    return None


def tokenize(text: str, found: Sequence[Detection], tokens: TokenMap, generalize: frozenset[str] = frozenset(), text_index: int | None = None) -> str:
    """``text`` with every span replaced, from the last to the first."""
    pieces, upto, fresh = [], len(text), []
    escape = lambda part: _TOKEN.sub(rf"{ESCAPED_OPEN}\1{ESCAPED_CLOSE}", part)
    for d in sorted(found, key=lambda d: -d.start):
        plain = generalized(d.category, d.text) if d.category in generalize and tokens.mode != "redact" else None
        token = plain if plain is not None else tokens.token(d.text, d.category)
        pieces += [escape(text[d.end : upto]), token]
        upto = d.start
        shown = f"[{d.category}_GENERALIZED]" if plain is not None else token
        row = {"category": d.category, "start": d.start, "end": d.end, "length": d.end - d.start, "confidence": d.confidence, "source": d.source, "token": shown}
        fresh.append(row if text_index is None else row | {"text_index": text_index})
    tokens.details.extend(reversed(fresh))
    return "".join(reversed([*pieces, escape(text[:upto])]))


def restorer(values: dict[str, str]) -> Callable[[str], str]:
    """Restores the tokens of ``values`` in any letter case, then takes escapes back."""
    by_lower = {t.lower(): v for t, v in values.items()}
    every = re.compile("|".join(re.escape(t) for t in sorted(by_lower, key=len, reverse=True)), re.I) if by_lower else None

    def restore(text: str) -> str:
        if every is not None:
            text = every.sub(lambda m: by_lower[m.group().lower()], text)
        return _ESCAPED.sub(r"[\1]", text)

    return restore


# ---- a column of texts, each its own scope ----------------------------------------------------

_MAP = pa.map_(pa.string(), pa.string())


def sanitize(df: DataFrame, text: str, engine: Engine | None = None, mode: str = "tokenize", generalize: Sequence[str] = (), out: str = "sanitized", tokens: str = "tokens") -> DataFrame:
    """``df`` with the text in tokens and the map token -> value, each row a scope of its own.

    Defined results: null stays null with an empty map; in mode ``redact`` maps are empty.
    Columns named like the new ones are replaced.
    """
    if mode not in ("tokenize", "redact"):
        raise ValueError("mode is tokenize or redact")
    kept = df.drop(*[c for c in (out, tokens) if c in df.columns and c != text])
    engine, at, plain = engine or Engine(), kept.columns.index(text), frozenset(generalize)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType()), T.StructField(tokens, T.MapType(T.StringType(), T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, maps = [], []
            for t in b.column(at).to_pylist():
                m = TokenMap(mode)
                new.append(tokenize(t, engine.detect(t), m, plain) if t and not t.isspace() else t)
                maps.append(list(m.reverse.items()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string()), pa.array(maps, _MAP)], names=schema.names)

    return kept.mapInArrow(run, schema)


def desanitize(df: DataFrame, text: str, tokens: str, out: str = "restored") -> DataFrame:
    """``df`` with the tokens of each row's map restored in its text."""
    kept = df.drop(out) if out in df.columns and out != text else df
    at, maps_at = kept.columns.index(text), kept.columns.index(tokens)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if t is None else restorer(dict(m or ()))(t) for t, m in zip(b.column(at).to_pylist(), b.column(maps_at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


# ---- a table of detections, scopes of many texts ---------------------------------------------


def number_tokens(found: DataFrame, scope: Sequence[str], order: Sequence[Column], value: str = "text", category: str = "category") -> DataFrame:
    """``scope, value, category, idx, token``: one row per value of a scope.

    ``order`` gives the order in which spans are replaced: texts forward, spans of a text
    backward.  The first occurrence of a value decides its category; numbers count up per scope
    and category.  Two passes: an aggregation that combines map-side, and a window over distinct
    values only.  A hot scope is one window partition of its distinct values.
    """
    seen = (
        found.select(*scope, F.trim(value).alias("value"), F.col(category).alias("_c"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("_at"))
        .groupBy(*scope, "value")
        .agg(F.min_by("_c", "_at").alias("category"), F.min("_at").alias("_at"))
    )
    w = Window.partitionBy(*scope, "category").orderBy("_at")
    return seen.withColumn("idx", F.row_number().over(w).cast("bigint") - 1).select(*scope, "value", "category", "idx", F.concat(F.lit("["), "category", F.lit("_"), "idx", F.lit("]")).alias("token"))


def splice(text: Column, spans: Column) -> Column:
    """``text`` with each span of ``array<struct<start:int,end:int,token:string>>`` (0-based, in
    any order, not overlapping) replaced by its token."""
    last_first = F.array_sort(spans, lambda a, b: F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).otherwise(0))
    return F.aggregate(last_first, text, lambda acc, s: F.overlay(acc, s["token"], s["start"] + 1, s["end"] - s["start"]))


def sanitize_scoped(df: DataFrame, keys: Sequence[str], scope: Sequence[str], order: Sequence[str], text: str, engine: Engine | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts in tokens that are shared in a scope, and the table of tokens.

    ``keys`` identify a text, ``scope`` are the columns of its scope and ``order`` those that
    order the texts in it (a conversation: ``conv_id`` and ``turn``).  Result: ``keys`` and
    ``sanitized``; ``scope, value, category, idx, token``.
    """
    from prismveil.operators.detection import detections
    from prismveil.plans.storage import materialise

    columns = list(dict.fromkeys([*keys, *scope, *order]))
    found = materialise(detections(df, columns, text, engine), "spans")
    tokens = materialise(number_tokens(found, scope, [*[F.col(c) for c in order], -F.col("start")]), "tokens")
    used = found.withColumn("value", F.trim("text")).join(tokens.select(*scope, "value", "token"), [*scope, "value"])
    spans = used.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "token")).alias("_spans"))
    base = df.select(*keys, text).distinct()
    out = base.join(spans, list(keys), "left").select(
        *keys, F.when(F.col("_spans").isNull(), escape_tokens(F.col(text))).otherwise(splice(F.col(text), F.col("_spans"))).alias("sanitized")
    )
    return out, tokens
