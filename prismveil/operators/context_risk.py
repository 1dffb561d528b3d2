"""How much a text in tokens still says about persons: density, descriptors and relations."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and phrases that count.
DESCRIPTORS = frozenset("ceo president founder director chairman chairwoman wife husband daughter son mother father only tallest youngest oldest first last sole chief head lead senior junior".split())
RELATIONS = (
    "married", "divorced", "works at", "employed by", "lives in", "born in", "graduated from", "founded", "owns", "manages",
    "reports to", "hired by", "sister of", "brother of", "daughter of", "son of", "wife of", "husband of",
)

_TOKEN = re.compile(r"\[[a-z][a-z0-9_]*_(?:\d+|redacted)\]", re.A)
_AROUND, _NEAR, _WARNINGS = 5, 50, 5

RISK = T.StructType(
    [
        T.StructField("token_density", T.DoubleType()),
        T.StructField("identifying_descriptors", T.IntegerType()),
        T.StructField("relationship_edges", T.IntegerType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)


def round3(x: float) -> float:
    return math.floor(x * 1000 + 0.5) / 1000


def assess(text: str | None) -> dict:
    """The assessment of one text; blank texts have none of anything and level ``low``."""
    if text is None or not text.strip():
        return {"token_density": 0.0, "identifying_descriptors": 0, "relationship_edges": 0, "risk_score": 0.0, "risk_level": "low", "warnings": []}
    low = text.lower()
    words = re.split(r"\s+", low)
    n_tokens = len(_TOKEN.findall(low))
    warnings, descriptors, edges = [], 0, 0
    with_token = [bool(_TOKEN.search(w)) for w in words]
    for i, w in enumerate(words):
        bare = w.strip(".,;:!?\"'()[]")
        if bare in DESCRIPTORS and any(with_token[max(0, i - _AROUND) : i + _AROUND + 1]):
            descriptors += 1
            warnings.append(f"descriptor '{bare}' near a token")
    for phrase in RELATIONS:
        at = low.find(phrase)
        while at >= 0:
            end = at + len(phrase)
            if _TOKEN.search(low[max(0, at - _NEAR) : at]) and _TOKEN.search(low[end : end + _NEAR]):
                edges += 1
                warnings.append(f"relation '{phrase}' between tokens")
            at = low.find(phrase, at + 1)
    density = n_tokens / max(len(words), 1)
    score = min(1.0, 1.5 * density + 0.15 * descriptors + 0.2 * edges)
    level = "high" if score > 0.7 else "medium" if score > 0.3 else "low"
    return {"token_density": round3(density), "identifying_descriptors": descriptors, "relationship_edges": edges, "risk_score": round3(score), "risk_level": level, "warnings": warnings[:_WARNINGS]}


def token_density(text: Column) -> Column:
    """The density alone, native: tokens per word, three decimals; 0 for blank and null texts."""
    low = F.lower(text)
    tokens = F.regexp_count(low, F.lit(r"\[[a-z][a-z0-9_]*_(?:[0-9]+|redacted)\]"))
    words = F.size(F.split(low, r"\s+"))
    density = F.floor(tokens / words * 1000 + F.lit(0.5)).cast("double") / 1000
    return F.when(text.isNull() | text.rlike(r"\A\s*\z"), 0.0).otherwise(density)


def with_risk(df: DataFrame, text: str, out: str = "risk") -> DataFrame:
    """``df`` with the assessment of ``text``; an existing column ``out`` is replaced."""
    kept = df.drop(out) if out in df.columns else df
    schema = T.StructType([*kept.schema.fields, T.StructField(out, RISK)])
    at = kept.columns.index(text)
    kind = pa.struct([("token_density", pa.float64()), ("identifying_descriptors", pa.int32()), ("relationship_edges", pa.int32()), ("risk_score", pa.float64()), ("risk_level", pa.string()), ("warnings", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([assess(t) for t in b.column(at).to_pylist()], kind)], names=schema.names)

    return kept.mapInArrow(run, schema)
