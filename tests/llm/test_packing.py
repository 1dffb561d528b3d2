import itertools
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from prismveil.llm import packing

SF = "/root/testdata/sf0.001"


def test_hilbert_neighbours_touch():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    key = packing.hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    assert np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


@pytest.mark.parametrize("window", [3, 64, 4096])
def test_pack_keeps_every_token(window):
    sizes = np.random.default_rng(0).integers(0, 5000, 3000)
    boxes = packing.pack_in_order(sizes, 2048, window)
    seen = defaultdict(list)
    for box in boxes:
        assert sum(x[3] for x in box) <= 2048
        for i, part, start, n in box:
            seen[i].append((part, start, n))
    for i, size in enumerate(sizes):
        parts = sorted(seen[i])
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for _, _, n in parts) == size
        assert all(s == p * 2048 for p, s, _ in parts)
        assert len(parts) == 1 or size > 2048


def test_fill_is_high_on_many_texts():
    sizes = np.random.default_rng(1).lognormal(6.5, 0.8, 20_000).astype(int)
    boxes = packing.pack_in_order(sizes, 2048)
    assert sizes.sum() / (2048 * len(boxes)) > 0.985


def test_containers_cover_all_documents(spark):
    rows = entry.queries()["p7_containers"](spark, SF).collect()
    ids = {r.doc_id: len(r.ids) for r in entry.queries()["p6_ids"](spark, SF).collect()}
    tokens, load = defaultdict(int), defaultdict(int)
    for r in rows:
        tokens[r.doc_id] += r.n_tokens
        load[r.container_id] += r.n_tokens
    assert dict(tokens) == ids and max(load.values()) <= 2048


def test_equal_texts_nulls_and_an_empty_table(spark, ranks):
    raw, pattern = ranks
    df = spark.createDataFrame([(i, "the same text again") for i in range(50)] + [(50, None), (51, "")], "id long, t string")
    m = packing.measure(df, "id", "t", raw, pattern)
    got = packing.containers(m, "id", 10, 52).collect()
    assert len(got) == 52 and len({r.container_id for r in got if r.n_tokens}) == 25
    assert packing.containers(packing.measure(df.limit(0), "id", "t", raw, pattern), "id", 10, 0).collect() == []
