"""Processing only new or changed records.

Every partition of a table (a delivery, a day) has a *fingerprint*: its row count and two
additive hashes of its rows.  Additive means that the order of rows and the way they were
split over files do not matter and that partial fingerprints add up, so one map-side
combined aggregation yields all of them.  A partition needs work when its fingerprint
differs from the one recorded by the last successful run.  Only such partitions are
recomputed, each replaced atomically through dynamic partition overwrite, and the record of
a partition is written after its data: a run that dies in between repeats that partition
and ends with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismveil.plans.storage import materialise

#: Broadcasting a fingerprint table is allowed up to this many partitions (about 60 bytes each).
MAX_BROADCAST_PARTITIONS = 200_000

FINGERPRINT = ("n_rows", "hash_lo", "hash_hi")


def row_hash(columns: Sequence[str]) -> Column:
    """64-bit hash of the named columns; null and the empty string hash differently."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.xxhash64(*parts)


def fingerprints(df: DataFrame, partition_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per partition: its columns, ``n_rows``, ``hash_lo`` and ``hash_hi``.

    The halves of the row hash are summed as decimals of 38 digits, which no number of rows
    overflows.  Null partition values form a partition; an empty table has none.
    """
    h = row_hash(columns)
    low = h.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(20,0)")
    high = F.shiftrightunsigned(h, 32).cast("decimal(20,0)")
    return (
        df.select(*partition_by, low.alias("_lo"), high.alias("_hi"))
        .groupBy(*partition_by)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_lo").cast("decimal(38,0)").alias("hash_lo"), F.sum("_hi").cast("decimal(38,0)").alias("hash_hi"))
    )


def _small(df: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast if its size was counted and is within the bound."""
    n = df.limit(MAX_BROADCAST_PARTITIONS + 1).count()
    return F.broadcast(df) if n <= MAX_BROADCAST_PARTITIONS else df


def changed_partitions(current: DataFrame, recorded: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Partitions of ``current`` whose fingerprint is not recorded, as ``partition_by`` columns.

    A partition that is recorded with another fingerprint, or not at all, is returned.
    Partitions that vanished from ``current`` are not.
    """
    keys = [*partition_by, *FINGERPRINT]
    a, b = current.select(*keys).alias("a"), recorded.select(*keys).distinct().alias("b")
    same = None
    for k in keys:
        cond = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = cond if same is None else same & cond
    return a.join(b, same, "left_anti").select(*[F.col(f"a.{p}").alias(p) for p in partition_by])


def latest_records(spark: SparkSession, state: str, partition_by: Sequence[str], like: DataFrame) -> tuple[DataFrame, int]:
    """The last recorded fingerprint of each partition and the number of the last run; ``like`` has
    the schema of fingerprints and stands in where nothing was recorded."""
    try:
        log = spark.read.parquet(state)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], like.schema), 0
    w = Window.partitionBy(*partition_by).orderBy(F.col("run").desc())
    last = log.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return last, log.agg(F.max("run")).first()[0] or 0


def pending_entries(
    rows: DataFrame,
    target: str,
    state: str,
    entry: str = "event_id",
    version: str = "entry_hash",
    partition: str = "delivery_no",
    tie_break: Sequence[str] = ("received_at",),
) -> DataFrame:
    """Entries whose current form no run has processed: ``event_id, entry_hash, change_kind``.

    ``rows`` has one row per delivery of an entry.  ``target`` and ``state`` are what
    ``process_increment`` left: the forms processed so far and the fingerprints recorded with
    them.  The current form is the row with the greatest ``delivery_no`` (ties: the greatest
    ``tie_break`` columns, then the greatest hash).

    Only partitions whose fingerprint is not the recorded one are read for cases: a row that
    changed inside a recorded partition changes its fingerprint and shows.  Their entries meet
    the processed forms in one grouping, which tells current from outdated and new from changed.
    Forms combine map-side before the shuffle, so a hot entry costs one row per form and task.

    Defined results: rows with a null entry id are no entries; a null hash is a form of its
    own; repeated rows count once; with nothing processed every entry is ``new``; an empty table
    gives no rows.
    """
    spark = rows.sparkSession
    columns = [entry, version, partition, *tie_break]
    now = fingerprints(rows, [partition], [entry, version])
    recorded, _ = latest_records(spark, state, [partition], now)
    todo = changed_partitions(now, recorded, [partition]).withColumnRenamed(partition, "_todo")
    fresh = rows.select(*columns).join(_small(todo), F.col(partition).eqNullSafe(F.col("_todo")), "left_semi")
    try:
        held = spark.read.schema(rows.select(*columns).schema).parquet(target)
    except AnalysisException:
        held = rows.select(*columns).limit(0)
    at = F.struct(F.col(partition), *[F.col(c) for c in tie_break])
    slim = lambda df, is_open: df.select(F.col(entry).alias("_e"), F.col(version).alias("_v"), at.alias("_at"), F.lit(is_open).alias("_open"))
    both = slim(fresh, True).unionByName(slim(held, False)).filter(F.col("_e").isNotNull())
    forms = both.groupBy("_e", "_v").agg(F.max("_at").alias("_at"), F.min("_open").alias("_open"), F.max("_open").alias("_seen"))
    entries = forms.groupBy("_e").agg(
        F.max(F.struct("_at", "_v", "_open")).alias("_last"),
        F.min("_open").alias("_fresh"),
        F.max("_seen").alias("_seen"),
    )
    return entries.filter(F.col("_seen") & F.col("_last._open")).select(
        F.col("_e").alias(entry),
        F.col("_last._v").alias(version),
        F.when(F.col("_fresh"), F.lit("new")).otherwise(F.lit("changed")).alias("change_kind"),
    )


def latest_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` columns of each non-null ``key``.

    Spark limits each group to one row before the shuffle, so hot keys stay cheap.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.filter(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def _partition_paths(df: DataFrame, partition_by: Sequence[str]) -> set[str]:
    """The folders, below a table's own, of the partitions in ``df``."""
    name = df.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    rows = df.select(*[F.col(p).cast("string").alias(p) for p in partition_by]).distinct().collect()
    return {"/".join(name(p, v) for p, v in zip(partition_by, r)) for r in rows}


def _delete(spark: SparkSession, table: str, folders: set[str]) -> None:
    for folder in sorted(folders):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{folder}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def process_increment(
    source: DataFrame,
    target: str,
    state: str,
    partition_by: Sequence[str],
    columns: Sequence[str],
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> int:
    """Bring the table at ``target`` up to date; returns the number of partitions redone or removed.

    ``transform`` maps the rows of changed partitions to result rows and must keep the
    partition columns.  ``state`` holds the recorded fingerprints of successful runs; a
    later record of a partition wins.  Order of writes: data first (dynamic partition
    overwrite replaces whole partitions), record second.  After a failure in between, the
    next run redoes the same partitions and replaces them, so nothing is lost or doubled.
    A partition whose transform yields no rows, or that vanished from the source, is deleted
    from the target before its record is written; a vanished one is recorded with no rows, so
    that it is redone should it come back.
    """
    spark = source.sparkSession
    now = materialise(fingerprints(source, partition_by, columns), "increment-now")
    recorded, run = latest_records(spark, state, partition_by, now)
    todo = changed_partitions(now, recorded, partition_by)
    known = recorded.filter("n_rows > 0")
    gone = known.alias("a").join(now.alias("b"), [F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")) for p in partition_by], "left_anti")
    todo, gone = materialise(todo, "increment-todo"), materialise(gone.select(*partition_by), "increment-gone")
    n, n_gone = todo.count(), gone.count()
    if not n and not n_gone:
        return 0
    same = None
    for p in partition_by:
        cond = source[p].eqNullSafe(todo[p])
        same = cond if same is None else same & cond
    # one snapshot of the changed partitions: what is processed is what is recorded, whatever
    # arrives meanwhile
    work = materialise(source.join(_small(todo), same, "left_semi"), "increment-work")
    result = materialise(transform(work), "increment-result")
    (
        result.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(target)
    )
    stale = _partition_paths(todo.unionByName(gone), partition_by)
    unchanged = now.alias("a").join(todo.alias("b"), [F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")) for p in partition_by], "left_anti")
    # different values can share a folder (null and the empty string)
    _delete(spark, target, stale - _partition_paths(result, partition_by) - _partition_paths(unchanged, partition_by))
    record = fingerprints(work, partition_by, columns).unionByName(gone.withColumns({c: F.lit(0).cast(now.schema[c].dataType) for c in FINGERPRINT}))
    record.withColumn("run", F.lit(run + 1)).write.mode("append").parquet(state)
    return n + n_gone
