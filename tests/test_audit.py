import hashlib
import json
from functools import reduce

import pytest

from prismveil.functions.canonical import canonical, entry_hash
from prismveil.operators import attestation, audit_chain, compliance, evaluation
from prismveil.sources import audit_log


def chain(n, prev="0" * 64, start=0):
    out = []
    for i in range(start, start + n):
        e = {"seq": i, "event_id": f"e{i}", "prev_hash": prev, "value": i / 2, "text": "é"}
        e["entry_hash"] = prev = entry_hash(e)
        out.append(e)
    return out


def write(folder, name, rows):
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n")


@pytest.mark.parametrize(("value", "text"), [
    (1.0, "1"), (0.5, "0.5"), (1e-7, "1e-7"), (1e-6, "0.000001"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (-0.0, "0"), (123456.789, "123456.789"), (2.5e-5, "0.000025"), (1.5e300, "1.5e+300"),
    ({"b": [1, None, True], "a": "é\n"}, '{"a":"é\\n","b":[1,null,true]}'), ({"\U0001f600": 1, "￮": 2}, '{"\U0001f600":1,"￮":2}'), ([], "[]"), ({}, "{}"),
])
def test_canonical(value, text):
    assert canonical(value) == text


def test_canonical_refuses():
    for bad in (float("nan"), float("inf"), {"__proto__": 1}):
        with pytest.raises(ValueError):
            canonical(bad)
    with pytest.raises(TypeError):
        canonical(object())


def test_a_whole_log_verifies_and_can_be_continued(spark, tmp_path):
    rows = chain(5)
    write(tmp_path, "audit_2026-01-01.jsonl", rows[:2])
    write(tmp_path, "audit_2026-01-02.jsonl", rows[2:])
    lines = audit_log.read(spark, str(tmp_path))
    assert lines.count() == 5 and audit_chain.verify_lines(lines).collect() == []
    assert audit_log.recovery_point(lines) == (5, rows[-1]["entry_hash"])
    audit_log.write(lines.selectExpr("raw", "concat(day, 'T00:00:00Z') as timestamp"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 5


def test_errors_of_a_damaged_log(spark, tmp_path):
    rows = chain(6)
    rows[1] = rows[1] | {"value": 9}
    rows[4] = rows[4] | {"prev_hash": "f" * 64}
    write(tmp_path, "audit_2026-01-01.jsonl", [*rows[:3], "{not json", '"text"'])
    write(tmp_path, "audit_2026-01-02.jsonl", rows[3:])
    got = {(r.file[6:16], r.line_no, r.error) for r in audit_chain.verify_lines(audit_log.read(spark, str(tmp_path))).collect()}
    assert got == {
        ("2026-01-01", 2, "Entry tampered"), ("2026-01-01", 4, "Invalid JSON"), ("2026-01-01", 5, "Invalid JSON"),
        ("2026-01-02", 2, "Entry tampered"), ("2026-01-02", 2, "Chain broken"),
    }
    write(tmp_path / "..", "x", [])
    bad = tmp_path / "bad"
    bad.mkdir()
    write(bad, "audit_2026-01-01.jsonl", ["{", "nothing"])
    with pytest.raises(ValueError, match="cannot be continued"):
        audit_log.recovery_point(audit_log.read(spark, str(bad)))


def test_build_folds_each_chain_alone(spark):
    rows = [(c, i, f"p{c}{i}") for c in ("a", None, "b") for i in range(4)]
    got = {(r.c, r.seq): r for r in audit_chain.build(spark.createDataFrame(rows, "c string, o int, p string"), "c", ["o"], "p").collect()}
    for c in ("a", None, "b"):
        h = audit_chain.GENESIS
        for i in range(4):
            assert got[c, i].prev_hash == h
            h = hashlib.sha256(f"{h}p{c}{i}".encode()).hexdigest()
            assert got[c, i].entry_hash == h


def test_percent(spark):
    cases = {(1, 3): 33.33, (2, 3): 66.67, (4, 5): 80.0, (1, 8): 12.5, (7, 9): 77.78, (1, 16): 6.25, (3, 7): 42.86, (1, 1): 100.0, (1, 800): 0.13, (0, 0): 0.0}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "n long, d long, want double")
    assert df.filter(compliance.percent(df.n, df.d) != df.want).count() == 0


def test_requested_articles_have_rows(spark):
    e = spark.createDataFrame([(["A"], "d", "sanitize", None, None, None)], "article_ref array<string>, decision_id string, event_type string, bias_context struct<wipe_confirmed:boolean>, content_context struct<synthetic:boolean,labeled:boolean,deepfake:boolean>, pii_in_log boolean")
    got = {r.article: r.evidence_count for r in compliance.per_article(e, ["A", "Z"]).collect()}
    assert got == {"A": 1, "Z": 0}


def pair(a, b):
    return hashlib.sha256((a + b).encode()).hexdigest()


def root_of(level):
    while len(level) > 1:
        level = [pair(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def test_merkle_roots_and_proofs(spark):
    rows = [(b, i, hashlib.sha256(f"{b}{i}".encode()).hexdigest()) for b, n in ((1, 1), (2, 2), (3, 7), (None, 33)) for i in range(n)]
    got = {r.b: (r.n_leaves, r.root) for r in attestation.merkle_roots(spark.createDataFrame(rows, "b int, p int, h string"), "b", "p", "h").collect()}
    for b in (1, 2, 3, None):
        leaves = [h for x, _, h in rows if x == b]
        assert got[b] == (len(leaves), root_of(leaves))
        for i, leaf in enumerate(leaves):
            proof = attestation.merkle_proof(leaves, i)
            assert attestation.merkle_verify(leaf, proof, root_of(leaves)) and not attestation.merkle_verify("0" * 64, proof, root_of(leaves))
    assert attestation.merkle_roots(spark.createDataFrame([], "b int, p int, h string"), "b", "p", "h").collect() == []


def test_ed25519_and_certificates(spark):
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")  # first vector of RFC 8032
    assert attestation.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    sig = attestation.sign(seed, b"")
    assert sig.hex().startswith("e5564300c360ac729086e2cc806e828a") and attestation.verify(attestation.public_key(seed), b"", sig)
    assert not attestation.verify(attestation.public_key(seed), b"x", sig)
    cert = attestation.certificate(seed, {"version": "1", "entity_count": 2, "categories": {"EMAIL": 2}})
    assert attestation.verify_certificate(cert) and not attestation.verify_certificate(cert | {"entity_count": 3}) and not attestation.verify_certificate({})
    assert attestation.derive_key(b"s") == attestation.derive_key(b"s") != attestation.derive_key(b"t")
    body = canonical({k: cert[k] for k in attestation.SIGNED})
    df = spark.createDataFrame([(body, cert["signature"], cert["public_key"]), (body + " ", cert["signature"], cert["public_key"]), (None, None, None)], "b string, s string, p string")
    assert [r.valid for r in attestation.with_valid_signature(df, "b", "s", "p").collect()] == [True, False, False]


def test_scores_match_each_span_once(spark):
    schema = "id int, category string, start int, end int"
    found = spark.createDataFrame([(1, "A", 0, 10), (1, "A", 2, 10), (1, "B", 0, 4), (2, "A", 5, 6)], schema)
    true = spark.createDataFrame([(1, "A", 0, 8), (1, "B", 3, 9), (2, "A", 5, 6), (2, "C", 0, 1)], schema)
    got = {r.category: (r.tp, r.fp, r.fn, r.f1) for r in evaluation.scores(found, true, "id").collect()}
    assert got == {"A": (2, 1, 0, 0.8), "B": (0, 1, 1, 0.0), "C": (0, 0, 1, 0.0)}
    assert evaluation.span_pairs(found, true, ["id"]).count() == 3
    assert reduce(lambda a, r: a + r.tp, evaluation.scores(found.limit(0), true, "id").collect(), 0) == 0
