import numpy as np
import pandas as pd

import __spark_entry__ as entry
from prismveil.llm import digest
from prismveil.llm.queries import SHARES


def worst_rank_error(values, row):
    """How far the share of values below and up to each percentile is from its share."""
    values, worst = np.sort(values), 0.0
    for name, q in SHARES.items():
        below, upto = (np.searchsorted(values, row[name], side=s) / len(values) for s in ("left", "right"))
        worst = max(worst, below - q - 1 / len(values), q - upto - 1 / len(values))
    return worst


def test_merged_digests_keep_the_stated_error():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(3, 2, 100_000), np.full(30_000, 7.0), [-5.0, 1e300]])
    p = digest._Partial()
    for part in np.array_split(values, 200):  # sorted input is the hard case: every part differs
        q = digest._Partial()
        q.add_values(part)
        p.add_digests(pd.DataFrame([q.row()], columns=digest.DIGEST.names))
    n, skipped, lo, hi, means, weights = p.row()
    assert (n, skipped, lo, hi) == (len(values), 0, -5.0, 1e300)
    assert len(means) <= digest.SIZE and sum(weights) == n
    row = {k: digest.quantile(np.array(means), np.array(weights), lo, hi, s) for k, s in SHARES.items()}
    assert worst_rank_error(values, row) <= digest.RANK_ERROR


def test_p1_percentiles_over_all_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = pd.read_parquet(f"{sf}/audit_chain_py.parquet", columns=["provider", "model", "latency_ms"])
    got = {(r.provider, r.model): r for r in entry.queries()["p1_percentiles"](spark, sf).collect()}
    want = {tuple(None if pd.isna(x) else x for x in k): g["latency_ms"] for k, g in rows.groupby(["provider", "model"], dropna=False)}
    assert got.keys() == want.keys()
    for key, latency in want.items():
        good = latency[np.isfinite(latency)]
        assert (got[key].n_values, got[key].n_skipped) == (len(good), len(latency) - len(good))
        if len(good):
            assert (got[key].lo, got[key].hi) == (good.min(), good.max())
            assert worst_rank_error(good.to_numpy(), got[key]) <= digest.RANK_ERROR


def test_p1_empty_groups_and_table(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 1, float("nan")), ("a", 1, 2.0)], "m string, d int, v double")
    done = digest.merge_digests(digest.partial_digests(df, ["m"], "v"), ["m"])
    got = {r.m: (r.n_values, r.n_skipped, r.p) for r in digest.percentiles(done, ["m"], {"p": 0.5}).collect()}
    assert got == {None: (0, 2, None), "a": (1, 0, 2.0)}
    none = digest.merge_digests(digest.partial_digests(df.limit(0), ["m"], "v"), ["m"])
    assert digest.percentiles(none, ["m"], {"p": 0.5}).collect() == []
