"""A labelled corpus in one JSON object: ``{"samples": [{"id", "text", "tags", "entities"}]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "samples array<struct<id:string,text:string,tags:array<string>,entities:array<struct<category:string,start:int,end:int>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """``id, text, tags, entities`` of every sample."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.explode("samples").alias("s")).select("s.*")


def spans(samples: DataFrame) -> DataFrame:
    """``id, category, start, end`` of every labelled span."""
    return samples.select("id", F.explode("entities").alias("e")).select("id", "e.category", "e.start", "e.end")
