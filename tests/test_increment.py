import pytest

from prismveil.operators import incremental
from prismveil.operators.incremental import pending_entries, process_increment

SCHEMA = "day string, k int, ok boolean"
FIRST = [("a b/c", 1, True), ("a b/c", 2, True), ("d2", 3, True), (None, 4, True), ("d4", 5, True)]


def run(spark, tmp_path, rows):
    target = f"{tmp_path}/target"
    n = process_increment(spark.createDataFrame(rows, SCHEMA), target, f"{tmp_path}/state", ["day"], ["k", "ok"], lambda df: df.filter("ok"))
    return n, sorted((r.day, r.k) if r.day else ("", r.k) for r in spark.read.schema(SCHEMA).parquet(target).collect())


def test_partitions_that_yield_nothing_or_vanish_lose_their_rows(spark, tmp_path):
    assert run(spark, tmp_path, FIRST) == (4, [("", 4), ("a b/c", 1), ("a b/c", 2), ("d2", 3), ("d4", 5)])
    assert run(spark, tmp_path, FIRST)[0] == 0
    emptied = [(d, k, d not in ("a b/c", None)) for d, k, _ in FIRST]
    assert run(spark, tmp_path, emptied) == (2, [("d2", 3), ("d4", 5)])
    assert run(spark, tmp_path, emptied[:3] + emptied[4:])[0] == 1  # the null day vanishes, no rows left of it
    assert run(spark, tmp_path, emptied[:2] + emptied[4:]) == (1, [("d4", 5)])
    assert run(spark, tmp_path, emptied[:2] + emptied[4:])[0] == 0


def test_a_partition_that_comes_back_is_redone(spark, tmp_path):
    run(spark, tmp_path, FIRST)
    assert run(spark, tmp_path, FIRST[:3]) == (2, [("a b/c", 1), ("a b/c", 2), ("d2", 3)])
    assert run(spark, tmp_path, FIRST) == (2, [("", 4), ("a b/c", 1), ("a b/c", 2), ("d2", 3), ("d4", 5)])


ENTRY = "event_id string, entry_hash string, delivery_no int, received_at int"


def test_a_row_that_changes_inside_a_recorded_partition_shows(spark, tmp_path):
    target, state = f"{tmp_path}/target", f"{tmp_path}/state"
    rows = [("a", "h1", 1, 0), ("b", "h1", 1, 0), ("c", None, 1, 0), (None, "h9", 1, 0), ("a", "h1", 1, 0)]
    keep = lambda df: df.distinct()
    assert process_increment(spark.createDataFrame(rows, ENTRY), target, state, ["delivery_no"], ["event_id", "entry_hash"], keep) == 1
    assert pending_entries(spark.createDataFrame(rows, ENTRY), target, state).collect() == []
    changed = [("a", "h2", 1, 1), *rows[1:4], ("d", "h1", 2, 0), ("b", "h1", 2, 0)]
    got = {tuple(r) for r in pending_entries(spark.createDataFrame(changed, ENTRY), target, state).collect()}
    assert got == {("a", "h2", "changed"), ("d", "h1", "new")}


def test_nothing_processed_and_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([("a", "h1", 1, 0), ("a", "h2", 2, 0)], ENTRY)
    none = (f"{tmp_path}/t", f"{tmp_path}/s")
    assert [tuple(r) for r in pending_entries(df, *none).collect()] == [("a", "h2", "new")]
    assert pending_entries(df.limit(0), *none).collect() == []


def test_a_run_that_dies_before_its_record_is_repeated_without_loss_or_double(spark, tmp_path, monkeypatch):
    real, calls = incremental.fingerprints, []

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:  # data are written, the record is not
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(incremental, "fingerprints", dies)
    with pytest.raises(RuntimeError):
        run(spark, tmp_path, FIRST)
    monkeypatch.setattr(incremental, "fingerprints", real)
    assert run(spark, tmp_path, FIRST) == (4, [("", 4), ("a b/c", 1), ("a b/c", 2), ("d2", 3), ("d4", 5)])
    assert run(spark, tmp_path, FIRST)[0] == 0


def test_fingerprints_do_not_depend_on_order_or_cuts(spark):
    rows = [(i % 3, f"k{i % 50}", i) for i in range(600)]
    a = spark.createDataFrame(rows, "p int, k string, v int")
    b = spark.createDataFrame(rows[::-1], "p int, k string, v int").repartition(7)
    assert sorted(incremental.fingerprints(a, ["p"], ["k", "v"]).collect()) == sorted(incremental.fingerprints(b, ["p"], ["k", "v"]).collect())
