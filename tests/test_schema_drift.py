import json

from prismveil.operators import schema_drift

LINES = [
    '{"decisionId": null, "decision_id": "y"}',
    '{"categories": null, "category_counts": {"A": 1}}',
    '{"имя": 1, "名": 2, "New_Field": 3}',
    '{"event_id": "a", "event_id": "b", "seq": 4}',
    '[1]',
    '{bad',
]


def lines(spark):
    return spark.createDataFrame([("c", "f1", i, t) for i, t in enumerate(LINES)], "chain_id string, file_name string, line_no bigint, raw string")


def test_table_keeps_every_value(spark):
    got = {r.line_no: r for r in schema_drift.consistent_table(lines(spark)).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert got[0].decision_id == "y"
    assert json.loads(got[1].categories) == {"A": 1}
    assert json.loads(got[2].unknown_fields) == {"имя": 1, "名": 2, "New_Field": 3}
    assert (got[3].event_id, got[3].seq, got[3].unknown_fields) == ("b", 4, None)


def test_repeated_key_is_one_field_of_an_object(spark):
    found = {(r.field, r.n_lines) for r in schema_drift.footers(lines(spark)).collect()}
    assert {("event_id", 1), ("seq", 1)} <= found


def changes(spark, files, **kw):
    rows = [("c", f, i, t) for f, texts in files.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "chain_id string, file_name string, line_no bigint, raw string")
    return df, {tuple(r)[1:] for r in schema_drift.changes(df, **kw).collect()}


def test_changes_between_files(spark):
    files = {
        "f1": ['{"seq": 1, "model": "m", "decision_id": "d", "old": 1}', "{bad"],
        "f2": ['{"seq": null, "modelId": "m", "decision_id": "d"}'],
        "f3": ['{"seq": "3", "modelId": 4, "extra": true}'],
        "f4": [None, "", "[1]"],
        "f5": ['{"seq": "5"}'],
    }
    assert changes(spark, files)[1] == {
        ("f2", "model", "renamed"), ("f2", "old", "removed"), ("f3", "seq", "retyped"), ("f3", "modelId", "retyped"), ("f3", "decision_id", "removed"), ("f3", "extra", "added"),
        ("f4", "seq", "removed"), ("f4", "modelId", "removed"), ("f4", "extra", "removed"), ("f5", "seq", "added"),
    }


def test_an_unlisted_spelling_is_a_candidate_and_joins_by_another_table(spark):
    files = {"f1": ['{"seq": 1, "decision_id": "d"}'], "f2": ['{"seq": 2, "verdict_key": "d"}']}
    df, got = changes(spark, files)
    assert got == {("f2", "decision_id", "removed"), ("f2", "verdict_key", "added")}
    assert [tuple(r) for r in schema_drift.rename_candidates(df).collect()] == [("decision_id", "verdict_key", "string", 1, 0)]
    more = schema_drift.ALIASES | {"decision_id": ("string", ("verdict_key",))}
    assert changes(spark, files, aliases=more)[1] == {("f2", "decision_id", "renamed")}


def test_lifespans_are_islands_of_one_type(spark):
    df, _ = changes(spark, {"f1": ['{"a": 1}'], "f2": ['{"a": null}'], "f3": ['{"a": "x"}'], "f4": ['{"b": 1}'], "f5": ['{"a": "y"}']})
    spans = {(r.field, r.type, r.first_file, r.last_file, r.n_files) for r in schema_drift.lifespans(schema_drift.lives(schema_drift.footers(df))).collect()}
    assert spans == {("a", "number", "f1", "f2", 2), ("a", "string", "f3", "f3", 1), ("a", "string", "f5", "f5", 1), ("b", "number", "f4", "f4", 1)}


def test_an_empty_table(spark):
    df = lines(spark).limit(0)
    assert schema_drift.changes(df).collect() == [] and schema_drift.consistent_table(df).collect() == []


def test_columns_of_the_table_win_over_fields_of_their_name(spark):
    df = spark.createDataFrame([("c", "f", 0, '{"model": "m", "x": 1}', "own", 7, 8)], "chain_id string, file_name string, line_no bigint, raw string, model string, unknown_fields int, _fields int")
    r = schema_drift.consistent_table(df).first()
    assert (r.model, r.entry_model, r.unknown_fields, json.loads(r.entry_unknown_fields)) == ("own", "m", 7, {"x": 1})
