import numpy as np
import pytest

from prismveil.llm import crf, pii, pii_labels


@pytest.fixture(scope="module")
def trained(spark):
    return pii.model(spark)


def test_accuracy_on_rows_of_another_seed(trained):
    weights, trans = trained.value
    rows = pii_labels.table(600, seed=99)  # other fillings of the same frames, so no measure of unseen text
    found = crf.tag(crf.Words(), weights, trans, [t for t, _ in rows])
    want = {(i, a, c) for i, (_, s) in enumerate(rows) for a, _, c in s}
    got = {(i, a, c) for i, s in enumerate(found) for a, _, c in s}
    assert len(want & got) / len(want) > 0.95 and len(want & got) / len(got) > 0.95


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(0)
    k, lengths = 3, np.array([1, 4, 2, 0, 5])
    scores, trans = rng.normal(size=(lengths.sum(), k)), rng.normal(size=(k, k))
    at = 0
    for n, got in zip(lengths, crf.viterbi(scores, lengths, trans)):
        s = scores[at : at + n]
        at += n
        paths = np.array(np.meshgrid(*[range(k)] * n, indexing="ij")).reshape(n, -1).T if n else np.empty((0, 0), int)
        if n:
            value = [s[range(n), p].sum() + trans[p[:-1], p[1:]].sum() for p in paths]
            assert got.tolist() == paths[int(np.argmax(value))].tolist()
        else:
            assert len(got) == 0


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    lengths, k = np.array([3, 2]), 3
    scores, trans, gold = rng.normal(size=(5, k)), rng.normal(size=(k, k)), rng.integers(0, k, 5)

    def loglik(s, t):
        total, at = 0.0, 0
        for n in lengths:
            part, y = s[at : at + n], gold[at : at + n]
            paths = np.array(np.meshgrid(*[range(k)] * n, indexing="ij")).reshape(n, -1).T
            value = np.array([part[range(n), p].sum() + t[p[:-1], p[1:]].sum() for p in paths])
            total += part[range(n), y].sum() + t[y[:-1], y[1:]].sum() - np.log(np.exp(value).sum())
            at += n
        return total

    by_token, by_trans = crf._gradient(scores, lengths, gold, trans)
    h = 1e-5
    for i, j in ((0, 1), (4, 2)):
        d = np.zeros_like(scores)
        d[i, j] = h
        assert abs((loglik(scores + d, trans) - loglik(scores - d, trans)) / (2 * h) - by_token[i, j]) < 1e-6
    d = np.zeros_like(trans)
    d[1, 2] = h
    assert abs((loglik(scores, trans + d) - loglik(scores, trans - d)) / (2 * h) - by_trans[1, 2]) < 1e-6


def test_spans_and_placeholders(spark, trained):
    text = "🙂 My name is Nora Brandt and I cannot open the portal.\nWrite to nora.brandt@mail.example or call +1 (415) 555-0123."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "  "), (5, "The export stops half way. Order 48215561 left the depot.")]
    df = spark.createDataFrame(rows, "id int, content string")
    got = {(r.id, s.start_pos, s.category) for r in pii.with_spans(df, "content", trained, ["id"]).collect() for s in r.spans}
    assert got == {(1, text.index("Nora"), "PERSON"), (1, text.index("nora."), "EMAIL"), (1, text.index("+1"), "PHONE")}
    new = [r.content for r in pii.redact(df, "content", trained).orderBy("id").collect()]
    assert new[0] == new[1] == "🙂 My name is [PERSON] and I cannot open the portal.\nWrite to [EMAIL] or call [PHONE]."
    assert new[2:5] == [None, "", "  "] and new[5] == rows[5][1]


def test_a_very_long_message_and_an_empty_table(spark, trained):
    text = "the portal shows an empty page again. " * 20_000 + "Mail: last.word@mail.example"
    df = spark.createDataFrame([(1, text)], "id int, content string")
    spans = pii.with_spans(df, "content", trained, ["id"]).first().spans
    assert [(s.start_pos, s.category) for s in spans][-1] == (text.index("last."), "EMAIL")
    assert pii.with_spans(df.limit(0), "content", trained, ["id"]).collect() == []
