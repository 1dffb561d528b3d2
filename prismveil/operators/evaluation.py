"""Found spans against true spans: overlap matching, precision, recall and F1."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the smaller span that must overlap.
OVERLAP = 0.5


def overlapping(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    return (shared > 0) & (shared >= OVERLAP * F.least(a_end - a_start, b_end - b_start))


def span_pairs(found: DataFrame, true: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All pairs of one text and category that overlap enough (a range join on equal keys)."""
    f = found.select(*keys, "category", F.col("start").alias("f_start"), F.col("end").alias("f_end"))
    t = true.select(*keys, "category", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    return f.join(t, [*keys, "category"]).filter(overlapping(F.col("f_start"), F.col("f_end"), F.col("t_start"), F.col("t_end")))


def scores(found: DataFrame, true: DataFrame, key: str) -> DataFrame:
    """``category, tp, fp, fn, precision, recall, f1``; each span is matched once, in order of
    position; figures have four decimals and are 0 where undefined."""

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        got = sorted(zip(frame.loc[frame["_f"], "start"], frame.loc[frame["_f"], "end"]))
        want = sorted(zip(frame.loc[~frame["_f"], "start"], frame.loc[~frame["_f"], "end"]))
        free, tp = list(want), 0
        for a, b in got:
            for i, (x, y) in enumerate(free):
                if min(b, y) - max(a, x) > 0 and min(b, y) - max(a, x) >= OVERLAP * min(b - a, y - x):
                    del free[i]
                    tp += 1
                    break
        return pd.DataFrame({"category": [frame["category"].iloc[0]], "tp": [tp], "fp": [len(got) - tp], "fn": [len(want) - tp]})

    both = found.select(key, "category", "start", "end", F.lit(True).alias("_f")).unionByName(true.select(key, "category", "start", "end", F.lit(False).alias("_f")))
    per_text = both.groupBy(key, "category").applyInPandas(match, "category string, tp long, fp long, fn long")
    total = per_text.groupBy("category").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    ratio = lambda n, d: F.coalesce(F.round(F.try_divide(n, d), 4), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return total.select("category", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
