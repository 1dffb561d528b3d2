import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismveil.functions import patterns
from prismveil.operators import context_risk
from prismveil.operators.detection import Config, Engine
from prismveil.operators.tokenisation import TokenMap, desanitize, entity_hash, restorer, sanitize, sanitize_scoped, tokenize
from prismveil.streaming.desanitizer import StreamDesanitizer, desanitize_chunks

ENGINE = Engine()
CLINICAL = Engine(config=Config(switches={s: True for _, s, _, _ in patterns.BUILTIN}))


def test_numbers_run_from_right_to_left():
    m = TokenMap()
    text = "a 94-year-old admitted 01/02/2021, discharged 01/09/2021, DOB 03/04/1926"
    assert tokenize(text, CLINICAL.detect(text), m) == "a [AGE_90PLUS_0] admitted [DATE_2], discharged [DATE_1], DOB [DATE_0]"
    assert [d["token"] for d in m.details] == ["[AGE_90PLUS_0]", "[DATE_2]", "[DATE_1]", "[DATE_0]"]


def test_a_value_has_one_token_in_its_scope_and_redaction_keeps_none():
    m = TokenMap()
    for text, want in (("a@b.de, c@d.de", "[EMAIL_1], [EMAIL_0]"), ("again a@b.de", "again [EMAIL_1]")):
        assert tokenize(text, ENGINE.detect(text), m) == want
    assert m.summary() == {"entity_count": 2, "categories": {"EMAIL": 3}, "tokens": ["[EMAIL_0]", "[EMAIL_1]"], "mode": "tokenize"}
    r = TokenMap("redact")
    assert tokenize("a@b.de", ENGINE.detect("a@b.de"), r) == "[EMAIL_REDACTED]" and r.summary()["entity_count"] == 0


def test_generalised_values():
    m = TokenMap()
    text = "aged 94, seen 01/02/2021 in Albany, NY 12207 and Fall, VT 03601"
    got = tokenize(text, CLINICAL.detect(text), m, frozenset({"DATE", "AGE_90PLUS", "ZIP"}))
    assert got == "aged 90+, seen 2021 in Albany, NY 122XX and Fall, VT 000XX"
    assert {d["token"] for d in m.details} == {"[DATE_GENERALIZED]", "[AGE_90PLUS_GENERALIZED]", "[ZIP_GENERALIZED]"}


def test_tokens_that_stand_in_a_text_are_not_restored():
    m = TokenMap()
    text = "fake [EMAIL_0] and a@b.de"
    safe = tokenize(text, ENGINE.detect(text), m)
    assert safe == "fake ［EMAIL_0］ and [EMAIL_0]" and restorer(m.reverse)(safe) == text
    assert restorer({"[X_0]": "$1 $& \\1"})("[x_0]!") == "$1 $& \\1!"
    assert restorer({"[X_1]": "one", "[X_10]": "ten"})("[X_10] [X_1]") == "ten one"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a@b.de ", "219-09-9999", " [EMAIL_0]", "[", "]", "😀", " call 4155550123 ", "x@y.org,", "\n", "［", "é"]), max_size=12).map("".join), st.lists(st.integers(1, 5), min_size=1, max_size=40))
def test_round_trip_in_one_piece_and_as_a_stream(text, cuts):
    if "［" in text:
        text = text.replace("［", "")
    m = TokenMap()
    safe = tokenize(text, ENGINE.detect(text), m)
    assert restorer(m.reverse)(safe) == text
    if "[" in text.replace("[EMAIL_0]", ""):
        return  # a stray bracket before a token hides it from the stream
    s, out, at = StreamDesanitizer(m.reverse), "", 0
    while at < len(safe):
        n = cuts[at % len(cuts)]
        out += s.feed(safe[at : at + n])
        at += n
    assert out + s.flush() == text


def test_stream_holds_back_forty_characters_at_most():
    s = StreamDesanitizer({"[A_0]": "v"})
    assert s.feed("[" + "x" * 39) == "" and s.feed("y") == "[" + "x" * 39 + "y"
    assert s.feed("[a") == "" and s.feed("_0]!") == "v!" and s.feed("[A_") == "" and s.flush() == "[A_"
    with pytest.raises(ValueError, match="exceeds"):
        StreamDesanitizer({}, max_chars=3).feed("abcd")


def test_columns(spark):
    df = spark.createDataFrame([(1, "a@b.de and a@b.de", "k"), (1, "a@b.de and a@b.de", "k"), (2, None, "k"), (3, "", None)], "id int, t string, tokens string")
    s = sanitize(df, "t")
    assert [(r.sanitized, dict(r.tokens)) for r in s.orderBy("id").collect()][0] == ("[EMAIL_0] and [EMAIL_0]", {"[EMAIL_0]": "a@b.de"})
    assert sorted((r.id, r.restored or "") for r in desanitize(s, "sanitized", "tokens").collect()) == [(1, "a@b.de and a@b.de")] * 2 + [(2, ""), (3, "")]
    assert sanitize(df.limit(0), "t").collect() == []


def test_conversation_scope_equals_one_map_per_conversation(spark):
    rows = [(c, t, f"u{t % 3}@x.org then u{(t + c) % 4}@y.org [EMAIL_0]") for c in range(4) for t in range(6)]
    df = spark.createDataFrame(rows, "conv int, turn int, text string")
    texts, tokens = sanitize_scoped(df, ["conv", "turn"], ["conv"], ["turn"], "text")
    got = {(r.conv, r.turn): r.sanitized for r in texts.collect()}
    for c in range(4):
        m = TokenMap()
        for t in range(6):
            text = rows[c * 6 + t][2]
            want = tokenize(text, ENGINE.detect(text), m)
            assert got[c, t].replace("［", "[").replace("］", "]") == want.replace("［", "[").replace("］", "]")
        assert {r.token: r.value for r in tokens.filter(f"conv = {c}").collect()} == m.reverse


def test_entity_hash_is_hmac(spark):
    for key in (b"k", b"x" * 100):
        got = spark.createDataFrame([("EMAIL", " A@b.de ")], "c string, v string").select(entity_hash(key, F.col("c"), F.col("v"))).first()[0]
        assert got == hmac.digest(key, b"EMAIL:a@b.de", "sha256").hex()


def test_context_risk():
    assert context_risk.assess(" ")["risk_level"] == "low"
    r = context_risk.assess("[PERSON_0] is the CEO, married to [PERSON_1]")
    assert (r["identifying_descriptors"], r["relationship_edges"], r["token_density"], r["risk_level"]) == (1, 1, 0.286, "high")
    assert context_risk.assess("the first of many words without any of them")["identifying_descriptors"] == 0
    many = context_risk.assess("[A_0] ceo " * 9)
    assert len(many["warnings"]) == 5 and many["risk_score"] == 1.0


def test_chunks_out_of_a_batch(spark):
    chunks = [("s", i, d) for i, d in enumerate(["hi [EM", "AIL_0", "]!", None, " [X"])] + [("u", 0, "plain [EMAIL_0]")]
    out = desanitize_chunks(spark.createDataFrame(chunks, "stream_id string, seq int, delta string"), spark.createDataFrame([("s", "[EMAIL_0]", "a@b.de")], "stream_id string, token string, value string"))
    got = sorted((r.stream_id, r.seq, r.text) for r in out.collect())
    assert got == [("s", 0, "hi "), ("s", 1, ""), ("s", 2, "a@b.de!"), ("s", 3, ""), ("s", 4, " [X"), ("u", 0, "plain [EMAIL_0]")]
