"""Counts of what a job detected, observed while it runs: no extra pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, detections: str = "detections", name: str = "detection") -> tuple[DataFrame, Observation]:
    """``df`` and an observation of ``texts``, ``texts_with_entities`` and ``entities``; read it
    after an action on ``df``."""
    o = Observation(name)
    n = F.coalesce(F.size(detections), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return df.observe(o, F.count(F.lit(1)).alias("texts"), F.count(F.when(n > 0, 1)).alias("texts_with_entities"), F.coalesce(F.sum(n), F.lit(0)).alias("entities")), o
