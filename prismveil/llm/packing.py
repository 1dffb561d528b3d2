"""Filling containers of fixed capacity with neighbours along a space-filling curve.

1. Every text becomes a hashed vector of its token ids, projected at once to ``DIMS`` numbers;
   with its size in tokens that is all that is kept, so texts are never shuffled.
2. The projections, standardised by the mean and deviation of all texts, are cells of a grid;
   the Hilbert curve through the grid gives one sort key in which neighbours stay near.
3. A range sort by that key (with the hash of the id behind it, so that any number of equal
   texts is cut into even ranges) and, inside each range, best fit over a window of
   neighbours.  A container that is not full stays open for the next window only, so it holds
   texts that lie near each other.

A text above the capacity is cut: full containers of its own and one rest that is packed like
any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismveil.llm import bpe
from prismveil.llm.encoding import slices

#: Dimensions of the projection and bits of each in the key.
DIMS, BITS = 3, 10
#: Buckets to which token ids are hashed, and the seed of their random projections.
BUCKETS, SEED = 1 << 15, 7
#: Neighbours that are fitted together, and texts in one range of the sort.
WINDOW, RANGE = 2048, 50_000

MEASURED = ["n_tokens", *[f"x{d}" for d in range(DIMS)]]


def projection(ids: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The hashed vector of token ids (its counts scaled to mean 1) in the projected space."""
    if not len(ids):
        return np.zeros(DIMS)
    bucket = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
    return directions[bucket].mean(axis=0)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each row of ``cells`` (n x dims, below 2**bits) along the Hilbert curve.

    The usual transform: from the highest bit down undo the rotations and mirrorings of the
    sub-cubes, then take the Gray code of the interleaved bits.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            mirrored = (x[i] & q) != 0
            swap = np.where(mirrored, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(mirrored, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        fix ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= fix
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def measure(df: DataFrame, key: str, text: str, ranks: Broadcast, pattern: str) -> DataFrame:
    """``key``, ``n_tokens`` and the projection of each text; null is an empty text."""
    schema = T.StructType([T.StructField("_key", df.schema[key].dataType), T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in MEASURED[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(ranks.value, pattern)
        directions = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS)).astype(np.float32)
        for part in slices(batches):
            ids = [np.frombuffer(enc.encode(t) if t else b"", dtype="<i4") for t in part.column(1).to_pylist()]
            x = np.array([projection(i, directions) for i in ids], dtype=float).reshape(-1, DIMS)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) for i in ids], pa.int64()), *[pa.array(c) for c in x.T]], names=schema.names)

    return df.select(df[key].alias("_key"), df[text].alias("_text")).mapInArrow(run, schema)


def with_curve_key(measured: DataFrame) -> DataFrame:
    """``measured`` with its Hilbert key; one row of means and deviations comes from all rows."""
    stats = measured.agg(*[f(c).alias(f"{n}_{c}") for c in MEASURED[1:] for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    # one row, so this join is no pairing of rows
    scaled = measured.join(F.broadcast(stats))
    side = 1 << BITS
    cells = [
        F.least(F.lit(side - 1), F.floor(side / (1 + F.exp(-1.702 * (F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"s_{c}"), F.lit(1e-12)))))).cast("int").alias(f"c{d}")
        for d, c in enumerate(MEASURED[1:])
    ]

    @F.pandas_udf(T.LongType())
    def position(*c: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([s.to_numpy() for s in c], axis=1)))

    return scaled.select("_key", "n_tokens", *cells).select("_key", "n_tokens", position(*[f"c{d}" for d in range(DIMS)]).alias("curve"))


class _Open:
    """Open containers by free space; finds the one with the least space that suffices."""

    def __init__(self) -> None:
        self.by_free: dict[int, list[list]] = {}
        self.mask = 0

    def put(self, free: int, box: list) -> None:
        self.by_free.setdefault(free, []).append(box)
        self.mask |= 1 << free

    def take(self, size: int) -> tuple[int, list] | None:
        fits = self.mask >> size
        if not fits:
            return None
        free = size + (fits & -fits).bit_length() - 1
        boxes = self.by_free[free]
        box = boxes.pop()
        if not boxes:
            self.mask &= ~(1 << free)
        return free, box

    def all(self) -> list[tuple[int, list]]:
        return [(f, b) for f, boxes in self.by_free.items() for b in boxes]


def pack_in_order(sizes: np.ndarray, capacity: int, window: int = WINDOW) -> list[list[tuple[int, int, int, int]]]:
    """Containers of texts given in curve order, as lists of (text, part, start, size).

    Within a window the largest texts come first, each into the fullest container it fits.
    What is open after that may be filled by the next window and is closed then.
    """
    done: list[list] = []
    old: list[tuple[int, list]] = []
    for at in range(0, len(sizes), window):
        items = []
        for i in range(at, min(at + window, len(sizes))):
            full, rest = divmod(int(sizes[i]), capacity)
            done.extend([(i, p, p * capacity, capacity)] for p in range(full))
            if rest or not full:
                items.append((rest, i, full))
        items.sort(key=lambda x: (-x[0], x[1]))
        boxes, opened = _Open(), len(done)
        for free, box in old:
            boxes.put(free, box)
        for size, i, part in items:
            hit = boxes.take(size)
            if hit is None:
                hit = (capacity, [])
                done.append(hit[1])
            hit[1].append((i, part, part * capacity, size))
            boxes.put(hit[0] - size, hit[1])
        fresh = {id(b) for b in done[opened:]}
        old = [(f, b) for f, b in boxes.all() if id(b) in fresh and f]
    return done


def containers(measured: DataFrame, key: str, capacity: int, n_texts: int) -> DataFrame:
    """Where each part of each text goes: ``key, part_no, token_start, n_tokens, container_id``.

    ``measured`` is a stored result of ``measure`` with ``n_texts`` rows.  Parts of a text
    cover its tokens without gap; only texts above ``capacity`` have more than one.  The name of
    a container is the key and part of its first text along the curve, so tasks need not agree on
    numbers.  Empty texts are parts of size 0 in a container that is there or their own.
    Defined results: repeated keys are texts of their own (their container names may repeat
    each other's, so give unique keys); null keys are the text ``null``; an empty table has no
    containers.
    """
    if capacity < 1:
        raise ValueError("a container must hold at least one token")
    schema = T.StructType(
        [T.StructField(key, measured.schema["_key"].dataType), T.StructField("part_no", T.IntegerType()), T.StructField("token_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("container_id", T.StringType())]
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a range holds about RANGE texts, three numbers each
        held = [b[["_key", "n_tokens"]] for b in batches]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        keys, out = rows["_key"], []
        for box in pack_in_order(rows["n_tokens"].to_numpy(), capacity):
            first = min(box)
            name = f"{'null' if pd.isna(keys[first[0]]) else keys[first[0]]}-{first[1]}"
            out.extend((i, p, s, n, name) for i, p, s, n in box)
        which = [o[0] for o in out]
        yield pd.DataFrame(
            {key: keys.take(which).to_numpy(), "part_no": [o[1] for o in out], "token_start": [o[2] for o in out], "n_tokens": [o[3] for o in out], "container_id": [o[4] for o in out]}
        )

    ranges = max(1, -(-n_texts // RANGE))
    spread = F.xxhash64("_key")
    placed = with_curve_key(measured).withColumn("_spread", spread)
    return placed.repartitionByRange(ranges, "curve", "_spread").sortWithinPartitions("curve", "_spread", "_key").mapInPandas(pack, schema)
