"""Percentiles from mergeable partial results: a merging centroid digest (t-digest, scale k1).

A digest is a sorted list of centroids (mean, weight) with the extremes.  Between neighbouring
centroid borders the scale ``k(q) = SIZE / (2 pi) * asin(2 q - 1)`` grows by at most 1, so a
centroid near the median holds at most ``pi / SIZE`` of the values and one near an end far
fewer.  Digests merge by merging their sorted centroids under the same bound.  Tasks digest
their own rows first; what is shuffled follows the number of groups, not of rows.  A second
pass counts the values below and up to each returned percentile and so certifies its error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Centroids per digest at most (about half of them are used).
SIZE = 500
#: Stated error: the rank of a returned percentile is off by at most this share of the values.
RANK_ERROR = 0.01
#: Ways in which the digests of one group are merged before its last merge.
SALTS = 32
#: Groups whose percentiles may be broadcast to the counting pass (about 100 bytes each).
MAX_BROADCAST_GROUPS = 100_000
#: Values a task keeps unmerged for a group.
BUFFER = 4 * SIZE

DIGEST = T.StructType(
    [
        T.StructField("n_values", T.LongType()),
        T.StructField("n_skipped", T.LongType()),
        T.StructField("lo", T.DoubleType()),
        T.StructField("hi", T.DoubleType()),
        T.StructField("means", T.ArrayType(T.DoubleType())),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
    ]
)


def merge(means: np.ndarray, weights: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of all given centroids or values (weight 1), at most about ``size``."""
    if len(means) == 0:
        return means, weights
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    upto = np.cumsum(weights)
    total = upto[-1]
    starts, at = [], 0
    while at < len(means):
        starts.append(at)
        q = (upto[at] - weights[at]) / total
        angle = np.arcsin(min(1.0, max(-1.0, 2 * q - 1))) + 2 * np.pi / size
        limit = total if angle >= np.pi / 2 else total * (np.sin(angle) + 1) / 2
        at = max(at + 1, int(np.searchsorted(upto, limit, side="right")))
    w = np.add.reduceat(weights, starts)
    # weights as shares first, so that huge values cannot overflow in the sum
    middle = np.add.reduceat(means * (weights / np.repeat(w, np.diff([*starts, len(means)]))), starts)
    # rounding must not move the mean of equal values off that value: a large tie may sit there
    return np.clip(middle, means[starts], means[[*(x - 1 for x in starts[1:]), len(means) - 1]]), w


def quantile(means: np.ndarray, weights: np.ndarray, lo: float, hi: float, q: float) -> float | None:
    """The value at share ``q``: linear between the middles of neighbouring centroids."""
    if len(means) == 0:
        return None
    total = weights.sum()
    middles = np.cumsum(weights) - weights / 2
    return float(np.interp(q * total, [0.0, *middles, total], [lo, *means, hi]))


class _Partial:
    """The digest of one group while values and digests are added."""

    def __init__(self) -> None:
        self.n = self.skipped = self.waiting = 0
        self.lo, self.hi = np.inf, -np.inf
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, means: np.ndarray, weights: np.ndarray) -> None:
        self.parts.append((means, weights))
        self.waiting += len(means)
        if self.waiting > BUFFER:
            self.squeeze()

    def squeeze(self) -> tuple[np.ndarray, np.ndarray]:
        means = np.concatenate([np.empty(0), *[m for m, _ in self.parts]])
        weights = np.concatenate([np.empty(0), *[w for _, w in self.parts]])
        self.parts, self.waiting = [merge(means, weights)], 0
        return self.parts[0]

    def add_values(self, values: np.ndarray) -> None:
        good = values[np.isfinite(values)]
        self.skipped += len(values) - len(good)
        if len(good):
            self.n += len(good)
            self.lo, self.hi = min(self.lo, good.min()), max(self.hi, good.max())
            self.add(good, np.ones(len(good)))

    def add_digests(self, frame: pd.DataFrame) -> None:
        self.skipped += int(frame["n_skipped"].sum())
        for n, lo, hi, means, weights in zip(frame["n_values"], frame["lo"], frame["hi"], frame["means"], frame["weights"]):
            if n:
                self.n += int(n)
                self.lo, self.hi = min(self.lo, lo), max(self.hi, hi)
                self.add(np.asarray(means, dtype=float), np.asarray(weights, dtype=float))

    def row(self) -> tuple:
        means, weights = self.squeeze()
        ends = (float(self.lo), float(self.hi)) if self.n else (None, None)
        return (self.n, self.skipped, *ends, means.tolist(), weights.tolist())


def _keys(df: DataFrame, by: Sequence[str]) -> list[T.StructField]:
    return [df.schema[c] for c in by]


def partial_digests(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One digest per group of ``by`` and task; merge them with ``merge_digests``.

    Null group values form groups.  Null, NaN and infinite values are no measurements; they
    are counted in ``n_skipped``.  Negative and huge values are values.
    """
    schema = T.StructType([*_keys(df, by), *DIGEST.fields])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, _Partial] = {}
        for batch in batches:
            values = batch[value].to_numpy(dtype=float, na_value=np.nan)
            groups = batch.groupby(list(by), dropna=False, sort=False).indices if len(batch) else {}
            for key, rows in groups.items():
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                held.setdefault(key, _Partial()).add_values(values[rows])
        out = pd.DataFrame([(*k, *p.row()) for k, p in held.items()], columns=schema.names, dtype=object)
        yield out

    return df.select(*by, F.col(value).cast("double").alias(value)).mapInPandas(digest, schema)


def merge_digests(digests: DataFrame, by: Sequence[str]) -> DataFrame:
    """One digest per group of ``by`` from any number of digests.

    A hot group may come with a digest of every task, so groups are merged in ``SALTS`` parts
    first and the parts, at most ``SALTS`` small rows a group, second.  Tasks read their groups
    in order and hold one at a time.
    """
    schema = T.StructType([*_keys(digests, by), *DIGEST.fields])
    k = len(by)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, p, done = None, _Partial(), []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(k + len(DIGEST))]
            for key, n, skipped, lo, hi, means, weights in zip(zip(*columns[:k]), *columns[k:]):
                if key != current:
                    if current is not None:
                        done.append((*current, *p.row()))
                    current, p = key, _Partial()
                p.skipped += skipped
                if n:
                    p.n += n
                    p.lo, p.hi = min(p.lo, lo), max(p.hi, hi)
                    p.add(np.array(means), np.array(weights))
            if done:
                yield _batch(done, batch.schema)
                done = []
        if current is not None:
            yield _batch([(*current, *p.row())], batch.schema)

    def level(df: DataFrame, *salt: str) -> DataFrame:
        return df.repartition(*by, *salt).select(*by, *DIGEST.names).sortWithinPartitions(*by).mapInArrow(fold, schema)

    salted = digests.withColumn("_salt", F.pmod(F.xxhash64("n_values", "lo", "hi", "means"), F.lit(SALTS)))
    return level(level(salted, "_salt"))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=schema.names)


def percentiles(digests: DataFrame, by: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """``by``, ``n_values``, ``n_skipped``, ``lo``, ``hi`` and one column per named share."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[*by, "n_values", "n_skipped", "lo", "hi"]].copy()
            for name, q in shares.items():
                out[name] = [
                    quantile(np.asarray(m, dtype=float), np.asarray(w, dtype=float), lo, hi, q)
                    for m, w, lo, hi in zip(b["means"], b["weights"], b["lo"], b["hi"])
                ]
            yield out

    fields = [*_keys(digests, by), *DIGEST.fields[:4], *[T.StructField(n, T.DoubleType()) for n in shares]]
    return digests.mapInPandas(read, T.StructType(fields))


def certify(rows: DataFrame, found: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``found`` with ``rank_error``: the largest share of values, over its percentiles, by which
    the rank of the returned value misses the asked rank, counted over all ``rows``.

    ``found`` is a stored result of ``percentiles``, one row per group.  A tie covers the ranks
    of all its values.  The counts combine map-side, so a hot group costs one row per task.  A
    group without values has error 0.
    """
    v = F.col(value).cast("double")
    good = rows.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))
    small = found.count() <= MAX_BROADCAST_GROUPS
    asked = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], *[F.col(n).alias(f"_p{i}") for i, n in enumerate(shares)])
    same = None
    for i, c in enumerate(by):
        cond = good[c].eqNullSafe(asked[f"_k{i}"])
        same = cond if same is None else same & cond
    met = good.join(F.broadcast(asked) if small else asked, same)
    counts = met.groupBy(*[f"_k{i}" for i in range(len(by))]).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(F.col("_v") < F.col(f"_p{i}"), 1)).alias(f"_b{i}") for i in range(len(shares))],
        *[F.count(F.when(F.col("_v") <= F.col(f"_p{i}"), 1)).alias(f"_u{i}") for i in range(len(shares))],
    )
    misses = [F.greatest(F.col(f"_b{i}") - q * F.col("_n"), q * F.col("_n") - F.col(f"_u{i}"), F.lit(0.0)) / F.col("_n") for i, q in enumerate(shares.values())]
    errors = counts.select(*[f"_k{i}" for i in range(len(by))], F.greatest(*misses, F.lit(0.0)).alias("rank_error"))
    same = None
    for i, c in enumerate(by):
        cond = found[c].eqNullSafe(errors[f"_k{i}"])
        same = cond if same is None else same & cond
    joined = found.join(errors, same, "left").drop(*[f"_k{i}" for i in range(len(by))])
    return joined.withColumn("rank_error", F.coalesce("rank_error", F.lit(0.0)))
