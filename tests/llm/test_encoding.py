import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from prismveil.llm import bpe, encoding

ODD = [
    "", " ", "  ", "\n\n", "a" * 3000 + "\n" + " " * 500 + "b", "é̀" * 50 + "٣٤Ⅷ²一二三 'S don't we'll'LL", "<|endoftext|>x", "😀👩‍👩‍👧 ok​zero﻿bom",
    "-" * 700 + "=" * 333, "\r\n\r\n\t\tx \n y", "ÃƒÆ'" * 20, "\x1c\x1d a\x85b c   d  　e\n\n  x", "漢字カナ" * 400,
]


def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_transducer_gives_the_ids_of_the_public_tokenizer(ranks):
    raw, pattern = ranks
    e, t = bpe.Encoder(bpe.read_ranks(raw.value), pattern), reference()
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab .-\n'sté漢字カ1٣  \x1f̀re!_=😀") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text in texts:
        assert np.frombuffer(e.encode(text), "<i4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text[:60])


def test_stores_may_be_emptied_at_any_time(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_KEPT", 5)
    raw, pattern = ranks
    e, t = bpe.Encoder(bpe.read_ranks(raw.value), pattern), reference()
    text = "The quick brown fox, jumping over 13 lazy dogs; encore une fois."
    for _ in range(3):
        assert np.frombuffer(e.encode(text), "<i4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_column_with_nulls_repeats_and_clashing_names(spark, ranks):
    raw, pattern = ranks
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", None)], "k int, text string, ids string")
    got = sorted((r.k, r.ids) for r in encoding.encode(df, "text", raw, pattern, ["k", "ids"]).collect())
    ids = reference().encode("Hello world").ids
    assert got == [(1, []), (2, []), (3, ids), (3, ids)]
    assert encoding.encode(df.limit(0), "text", raw, pattern, ["k"]).collect() == []


def test_round_trip(spark, ranks):
    raw, pattern = ranks
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "k int, text string")
    back = encoding.decode(encoding.encode(df, "text", raw, pattern, ["k"]), "ids", raw, ["k"])
    assert {r.k: r.text for r in back.collect()} == dict(enumerate(ODD))


def test_incremental_utf8_takes_any_cut():
    data = "aé漢😀\u0000z".encode() + b"\xff\xe2\x82" + b"a\xf0\x9f"
    want = data.decode("utf-8", "replace")
    rng = random.Random(2)
    for _ in range(200):
        m, out, at = bpe.Utf8(), "", 0
        while at < len(data):
            n = rng.randint(1, 4)
            out += m.feed(data[at : at + n])
            at += n
        got = out + m.end()
        assert got.replace("�", "") == want.replace("�", "")
        assert ("�" in got) and got.endswith("�")
