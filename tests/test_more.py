import base64
import json

import pytest
from pyspark.sql import functions as F

from prismveil import cli
from prismveil.functions import identifiers
from prismveil.functions.canonical import entry_hash
from prismveil.operators import attestation, conversations, detection, metrics, provenance, report
from prismveil.sources import audit_log, corpus


def test_identifiers(spark):
    assert identifiers.ulid(0, bytes(10)) == "0" * 26 and identifiers.ulid((1 << 48) - 1, b"\xff" * 10) == "7" + "Z" * 25
    df = spark.createDataFrame([(1_700_000_000_123, "k"), (None, "k")], "ms long, k string")
    got = [r[0] for r in df.select(identifiers.ulid_of(df.ms, df.k)).collect()]
    assert got[0][:10] == identifiers.ulid(1_700_000_000_123, bytes(10))[:10] and len(got[0]) == 26 and got[1] is None
    rows = [("m", "d", "i", "10.0.0.255", "20260102030405.5Z", "ok"), ("m", "", "i", "10.0.0.256", "2026", "x" * 65)]
    d = spark.createDataFrame(rows, "a string, b string, c string, ip string, t string, id string")
    out = d.select(identifiers.version_pin(d.a, d.b, d.c), identifiers.ipv4_number(d.ip), identifiers.generalized_time(d.t), identifiers.valid_decision_id(d.id)).collect()
    assert [tuple(r) for r in out] == [("m@d/i", 10 * 2**24 + 255, "2026-01-02T03:04:05.5Z", True), (None, None, None, False)]
    decisions = {"127.0.0.1": (True, True), "::1": (True, True), "10.1.2.3": (False, True), "8.8.8.8": (False, True), "169.254.169.254": (False, False), "::ffff:127.0.0.1": (True, True), "0.0.0.0": (False, False), "x": (False, False)}
    assert {ip: (identifiers.may_connect(ip), identifiers.may_connect(ip, True)) for ip in decisions} == decisions


def test_conversations(spark):
    rows = [(1, 0, "system", "Be kind.", None, "m"), (1, 1, "user", "I am a@b.de", '{"to": "c@d.de"}', "m"), (1, 2, "user", "a@b.de again", None, "m"), (2, 0, "user", "nothing", None, "m"), (3, 4, "user", "e@f.de", None, "m"), (3, 4, "user", "e@f.de", None, "m")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string, tool_arguments string, _map string")
    safe, tokens = conversations.sanitize_messages(df)
    got = {(r.conv_id, r.turn): (r.content, r.tool_arguments) for r in safe.collect()}
    assert got[1, 1] == ("I am [EMAIL_0]", '{"to": "[EMAIL_1]"}') and got[1, 2] == ("[EMAIL_0] again", None) and got[3, 4] == ("[EMAIL_0]", None) and len(got) == 5
    with_role = safe.join(df.select("conv_id", "turn", "role").distinct(), ["conv_id", "turn"])
    hinted = {(r.conv_id, r.turn): r.content for r in conversations.with_hint(with_role, tokens).collect()}
    assert hinted[1, 0] == "Be kind.\n" + conversations.HINT and hinted[3, 3] == conversations.HINT and hinted[2, 0] == "nothing"
    back = conversations.restore_messages(spark.createDataFrame([(1, "to [email_1]"), (9, "[EMAIL_0]")], "conv_id int, content string"), tokens)
    assert {r.conv_id: r.restored for r in back.collect()} == {1: "to c@d.de", 9: "[EMAIL_0]"}
    assert [r[0] for r in df.limit(1).select(conversations.skipped_model(F.lit("local/x"), ["local/"])).collect()] == [True]
    assert df.limit(1).select(conversations.present_tokens(F.lit("[B_0] [A_0]"), F.array(F.lit("[B_0]"), F.lit("[A_0]"), F.lit("[b_0]")))).first()[0] == ["[A_0]", "[B_0]"]


def test_parts(spark):
    df = spark.createDataFrame([(1, 0, [("text", "a@b.de", None, None), ("tool", None, "{}", "c@d.de a@b.de")])], "conv_id int, turn int, parts array<struct<type:string,text:string,args:string,result:string>>")
    out, tokens = conversations.sanitize_parts(df)
    assert [tuple(p) for p in out.first().parts] == [("text", "[EMAIL_0]", None, None), ("tool", None, "{}", "[EMAIL_1] [EMAIL_0]")] and tokens.count() == 2


def test_provenance(spark):
    seed = bytes(range(32))
    root = attestation.public_key(seed)
    m = provenance.derive_manifest({"key_id": "k", "valid_from": "2026-01-01T00:00:00Z"}, lambda t: attestation.sign(seed, t), root)
    assert provenance.root_status(m, provenance.MANIFEST_FIELDS, root) == "VALID" and provenance.root_status(m | {"key_id": "x"}, provenance.MANIFEST_FIELDS, root) == "INVALID"
    assert provenance.root_status(m, provenance.MANIFEST_FIELDS, None) == "UNVERIFIED_NO_KEY" and base64.b64decode(m["root_signature"])
    r = provenance.derive_revocations([{"key_id": "k", "revoked_at": "2026-02-01T00:00:00Z"}], "2026-03-01T00:00:00Z", lambda t: attestation.sign(seed, t), root)
    assert provenance.root_status(r, provenance.LIST_FIELDS, root) == "VALID"
    e = spark.createDataFrame([(i, "k" if i < 4 else "z", "c", t) for i, t in enumerate(["2025-12-31T00:00:00+00:00", "2026-01-15T00:00:00Z", "2026-02-02T00:00:00Z", "?", "2026-01-15T00:00:00Z"])], "i int, key_id string, certificate_hash string, timestamp string")
    manifests = spark.createDataFrame([("k", "2026-01-01T00:00:00Z", None)], "key_id string, valid_from string, valid_until string")
    revoked = spark.createDataFrame([("k", "2026-02-01T00:00:00Z"), ("k", "2026-05-01T00:00:00Z")], "key_id string, revoked_at string")
    got = {x.i: (x.key_state, x.revocation_state) for x in provenance.certificates_with_state(e, manifests, revoked).collect()}
    assert got == {0: ("BEFORE", "REVOKED_BUT_CERT_PREDATES"), 1: ("VALID", "REVOKED_BUT_CERT_PREDATES"), 2: ("VALID", "REVOKED"), 3: ("NO_TIME", "REVOKED"), 4: ("UNKNOWN_KEY", "NOT_REVOKED")}


def test_metrics(spark):
    df, o = metrics.observed(detection.with_detections(spark.createDataFrame([("a@b.de c@d.de",), (None,), ("x",)], "t string"), "t"))
    df.write.format("noop").mode("overwrite").save()
    assert o.get == {"texts": 3, "texts_with_entities": 1, "entities": 2}


@pytest.fixture
def log(tmp_path):
    prev, rows = "0" * 64, []
    for i, kind in enumerate(["sanitize", "content_generation", "bias_session_start"]):
        e = {"seq": i, "timestamp": f"2026-01-0{i + 1}T00:00:00Z", "event_type": kind, "entity_count": i, "article_ref": ["EU_AI_Act_Art_12", *(["EU_AI_Act_Art_50"] if i == 1 else [])], "prev_hash": prev, "pii_in_log": False, "categories": {"EMAIL": i}, "content_context": {"synthetic": True, "labeled": True, "modality": "text"} if i == 1 else None}
        e["entry_hash"] = prev = entry_hash(e)
        rows.append(json.dumps(e))
    (tmp_path / "audit_2026-01-01.jsonl").write_text("\n".join(rows) + "\n")
    return tmp_path


def test_report_and_command_line(spark, log, capsys):
    r = report.build(audit_log.read(spark, str(log)), articles=["EU_AI_Act_Art_50", "EU_AI_Act_Art_19"])
    assert r["verdict"] == "COMPLIANT" and [(a["article"][-2:], a["evidence_count"]) for a in r["articles"]] == [("19", 0), ("50", 1)]
    assert cli.main(["verify", str(log)], spark) == 0 and cli.main(["stats", str(log)], spark) == 0 and cli.main(["scan", "mail a@b.de"]) == 0
    assert "5-11 EMAIL" in capsys.readouterr().out
    assert cli.main(["report", str(log), "--out", str(log / "r.md")], spark) == 0 and "COMPLIANT" in (log / "r.md").read_text()
    path = log / "audit_2026-01-01.jsonl"
    path.write_text(path.read_text().replace('"entity_count": 1', '"entity_count": 7'))
    assert cli.main(["verify", str(log)], spark) == 1 and report.build(audit_log.read(spark, str(log)))["reasons"] == ["chain broken"]
    report.write(r, str(log / "r.json"))
    assert json.loads((log / "r.json").read_text())["verdict"] == "COMPLIANT"


def test_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"samples": [{"id": "1", "text": "a@b.de", "tags": ["regex"], "entities": [{"category": "EMAIL", "start": 0, "end": 6}]}, {"id": "2", "text": "x", "tags": [], "entities": []}]}, indent=1))
    samples = corpus.read(spark, str(tmp_path / "c.json"))
    assert samples.count() == 2 and [tuple(r) for r in corpus.spans(samples).collect()] == [("1", "EMAIL", 0, 6)]
