"""A text column as ids of a public tokenizer, and back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from prismveil.llm import bpe

#: Rows whose ids are held at once; a batch from the JVM is cut into such slices.
SLICE = 512


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a rank file for all executors; its size is that of the file (under 1 MB for
    the public ones), whatever the data."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(df: DataFrame, text: str, ranks: Broadcast, pattern: str, keep: Sequence[str], out: str = "ids") -> DataFrame:
    """Columns ``keep`` and the ids of ``text`` (array of int) without special tokens.

    Defined results: null and empty texts have no ids (an empty list, not null); the names of
    special tokens inside a text are ordinary text; repeated rows are encoded each; an empty
    table gives none.  A column of ``keep`` named like ``out`` is replaced.
    """
    keep = [c for c in keep if c != out]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(ranks.value, pattern)
        for part in slices(batches):
            ids = [enc.encode(t) if t else b"" for t in part.column(len(keep)).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], names=schema.names)

    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, ranks: Broadcast, keep: Sequence[str], out: str = "text") -> DataFrame:
    """Columns ``keep`` and the text of ``ids``; null ids are an empty text, unknown ids and
    bytes that are no UTF-8 give U+FFFD."""
    keep = [c for c in keep if c != out]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: t for t, i in bpe.read_ranks(ranks.value).items()}
        for part in slices(batches):
            texts = ["".join(bpe.decode(x or (), token)) for x in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return df.select(*keep, df[ids].alias("_ids")).mapInArrow(run, schema)
