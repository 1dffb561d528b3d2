"""The driver contract: every query is registered and agrees with its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from prismveil.plans import reference, training

SF = "/root/testdata/sf0.001"
TABLES = ("audit_chain_py", "audit_chain_bias_py", "audit_lines", "ingest_runs", "key_manifests", "messages", "documents", "events", "orders", "customer")
ALL = training.ORACLES | reference.ORACLES


def test_queries_registered():
    assert set(training.QUERIES) | set(reference.QUERIES) <= set(entry.queries())
    assert set(ALL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
