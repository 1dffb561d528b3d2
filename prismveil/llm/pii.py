"""Personal data in free text: found by the tagger, replaced by typed placeholders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from prismveil.llm import crf, pii_labels
from prismveil.llm.encoding import slices

_MODEL: list = []
SPANS = T.ArrayType(T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("category", T.StringType())]))
_ARROW = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("category", pa.string())]))
#: Digits that a phone number, and letters or digits that an identity number, have at least.
MIN_PHONE, MIN_ID = 7, 5


def model(spark: SparkSession) -> Broadcast:
    """Weights trained from the labelled table, once per driver process; their size is
    ``crf.BUCKETS`` x labels x 4 bytes (12 MB), whatever the data."""
    if not _MODEL:
        _MODEL.append(crf.train(pii_labels.table()))
    return spark.sparkContext.broadcast(_MODEL[0])


def plausible(text: str, start: int, end: int, category: str) -> bool:
    """The exact check behind the tagger: has the span what its category cannot be without?"""
    part = text[start:end]
    digits = sum(c.isdigit() for c in part)
    if category == "PHONE":
        return digits >= MIN_PHONE
    if category == "ID_NUMBER":
        return digits >= 4 and sum(c.isalnum() for c in part) >= MIN_ID
    if category == "ADDRESS":
        return digits > 0
    if category == "EMAIL":
        low = part.casefold()
        return "@" in part or "＠" in part or " at " in low or "(at)" in low or "[at]" in low
    return any(c.isalpha() for c in part)


def _tagged(texts: list[str | None], words: crf.Words, weights: object, trans: object) -> list[list[tuple[int, int, str]]]:
    known = list(dict.fromkeys(t for t in texts if t))
    spans = dict(zip(known, crf.tag(words, weights, trans, known)))
    return [[s for s in spans[t] if plausible(t, *s)] if t else [] for t in texts]


def with_spans(df: DataFrame, text: str, trained: Broadcast, keep: Sequence[str], out: str = "spans") -> DataFrame:
    """``keep`` and the spans of personal data in ``text``, offsets in code points.

    Defined results: null, empty and blank texts have none; repeated rows are tagged each; an
    empty table gives none.  A column of ``keep`` named like ``out`` is replaced.
    """
    keep = [c for c in keep if c != out]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (weights, trans) = crf.Words(), trained.value
        for part in slices(batches, 4096):
            spans = _tagged(part.column(len(keep)).to_pylist(), words, weights, trans)
            rows = [[{"start_pos": a, "end_pos": b, "category": c} for a, b, c in s] for s in spans]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, _ARROW)], names=schema.names)

    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, schema)


def redacted(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, c in spans:
        out += [text[at:a], f"[{c}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str, trained: Broadcast) -> DataFrame:
    """``df`` with ``text`` in which every mention is the placeholder of its type (``[EMAIL]``);
    all else stays as it is.  Null stays null."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (weights, trans) = crf.Words(), trained.value
        for part in slices(batches, 4096):
            texts = part.column(at).to_pylist()
            spans = _tagged(texts, words, weights, trans)
            new = pa.array([redacted(t, s) if t else t for t, s in zip(texts, spans)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:at], new, *part.columns[at + 1 :]], names=part.schema.names)

    return df.mapInArrow(run, df.schema)
