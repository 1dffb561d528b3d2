import json

import __spark_entry__ as entry
from prismveil.operators import shredding

SF = "/root/testdata/sf0.001"
LISTED = {"n": 9, "groups": [{"group": "A", "n": 4, "metrics": [{"metric": "tpr", "value": 0.5}], "ci": {"lo": 0.1, "hi": 0.9}}, {"group": "B", "n": 5}]}
LABELLED = {"groups": {"A": {"n": 4, "metrics": {"tpr": 0.5, "fpr": 0.25}}, "B": {"metrics": {"metric": "auc", "value": 0.7}}}}


def nodes(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "e string, t string")
    return shredding.json_node_table(df, "e", "t", "j")


def test_groups_and_metrics_keep_their_values(spark):
    n = nodes(spark, json.dumps(LISTED), json.dumps(LABELLED), json.dumps(json.dumps(LISTED)), "{bad", '{"groups": []}')
    groups = {(r.e, r.group, r.n, r.ci_lo, r.ci_hi) for r in shredding.group_table(n, "e", "j").collect()}
    listed = {("A", "4", "0.1", "0.9"), ("B", "5", None, None)}
    assert groups == {(e, *g) for e in "02" for g in listed} | {("1", "A", "4", None, None), ("1", "B", None, None, None)}
    metrics = sorted((r.e, r.group, r.metric, r.value) for r in shredding.metric_table(n, "e", "j").collect())
    assert metrics == [("0", "A", "tpr", "0.5"), ("1", "A", "fpr", "0.25"), ("1", "A", "tpr", "0.5"), ("1", "B", "auc", "0.7"), ("2", "A", "tpr", "0.5")]


def test_p4_nodes_hold_scalars_of_the_context_and_the_json(spark):
    got = entry.queries()["p4_nodes"](spark, SF).select("node", "scalar").collect()
    paths = {r.node for r in got if r.scalar is not None}
    assert "$.bias_context.session_id" in paths and "$.bias_metrics.n" in paths
    assert any(p.startswith("$.bias_metrics.groups") for p in paths)


def test_p4_bias_tables_agree_with_p4_found(spark):
    found = {tuple(r) for r in entry.queries()["p4_found"](spark, SF).filter("child_table in ('bias_groups', 'bias_metrics')").collect()}
    groups = {(r.event_id, "bias_groups", r.group_name) for r in entry.queries()["p4_bias_groups"](spark, SF).collect()}
    rows = entry.queries()["p4_bias_metrics"](spark, SF).collect()
    assert found == groups | {(r.event_id, "bias_metrics", f"{r.group_name}/{r.metric}") for r in rows}
    assert all(r.value is not None for r in rows)


def test_keys_with_dots_and_brackets_do_not_collide(spark):
    text = {"groups": {"a": {"metrics": {"x": 1}}, "a.metrics": {"y": 2}, "a[0]": {}, "b%2E": {"metrics": {"z.ci": 3}}}, "groupsX": {"q": {}}}
    n = nodes(spark, json.dumps(text))
    rows = {(r.child_table, r.child_key) for r in shredding.grouped_metrics(n, "e", "j").collect()}
    assert rows == {("bias_groups", g) for g in ("a", "a.metrics", "a[0]", "b%2E")} | {("bias_metrics", "a/x"), ("bias_metrics", "b%2E/z.ci")}
    df = spark.createDataFrame([("1", {"p.q": 1, "p": 2})], "e string, m map<string,int>")
    got = {r.label: r.scalar for r in shredding.value_table(shredding.node_table(df, "e", ("m",)), "e", "m").collect()}
    assert got == {"p.q": "1", "p": "2"}
    assert len({r.node for r in shredding.node_table(df, "e", ("m",)).collect()}) == 3


def test_very_deep_json_keeps_its_nodes():
    depth = 100_000
    got = shredding.json_nodes("[" * depth + '{"a": [1, "x"], "b": null}' + "]" * depth)
    assert len(got) == depth + 4
    assert shredding.json_nodes("[" * depth + "1" + "]" * (depth - 1)) == []
    assert shredding.json_nodes("[" * depth + '{"a" 1}' + "]" * depth) == []


def test_entities_with_null_elements_and_an_empty_table(spark):
    df = spark.createDataFrame([("1", [(1, None), None, (None, None)], "x")], "e string, d array<struct<a:int,b:string>>, label string")
    n = shredding.node_table(df, "e", ("d",))
    assert sorted((r.ordinal, r.a, r.b) for r in shredding.entity_table(n, "e", "d", ("a", "b")).collect()) == [(0, "1", None), (2, None, None)]
    assert shredding.node_table(df.limit(0), "e", ("d",)).collect() == []
