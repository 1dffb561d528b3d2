"""A linear-chain conditional random field over word shapes, in numpy.

Features of a token are integers mixed from properties of the token and its neighbours (word,
shape, beginnings, ends, line breaks), hashed into ``BUCKETS`` rows of weights; the properties
of a word are computed once per distinct word, the mixing runs over whole batches.  Training
maximises the likelihood of the labelled table by AdaGrad steps over forward-backward; decoding is
Viterbi, many sequences of like length at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np

#: Rows of feature weights; passes over the labelled table, rows of it per step, rate and decay.
BUCKETS, PASSES, STEP_ROWS, RATE, DECAY = 1 << 18, 6, 64, 0.25, 1e-6
#: Tokens decoded at a time.
BLOCK = 60_000

LABELS = ["O", *[f"{b}-{c}" for c in ("PERSON", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS") for b in "BI"]]
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_|\n")


def tokenize(text: str) -> tuple[list[str], list[int]]:
    words, starts = [], []
    for m in _TOKEN.finditer(text):
        words.append(m.group())
        starts.append(m.start())
    return words, starts


def shape(w: str) -> str:
    """Character classes with runs shortened: ``Ashby`` -> ``Xx``, ``DE`` -> ``XX``; digits keep
    their number up to 14, other characters stand for themselves."""
    if w.isdigit():
        return f"d{min(len(w), 14)}"
    if w.isalpha():
        if len(w) == 1:
            return "X" if w.isupper() else "x"
        if w.isupper():
            return "XX" if len(w) > 2 else "X2"
        if w[0].isupper():
            return "Xx" if w[1:].islower() else "XxX"
        return "xx" if w.islower() else "xX"
    return w


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace"))


class Words:
    """Properties of distinct words: word, shape, starts and ends, as hashes."""

    WIDTH = 7

    def __init__(self, max_kept: int = 300_000) -> None:
        self.at: dict[str, int] = {}
        self.rows: list[tuple[int, ...]] = []
        self.max_kept = max_kept
        self.add("\0")  # beyond the ends

    def add(self, w: str) -> int:
        i = self.at.get(w)
        if i is None:
            low = w.casefold() if w.isalpha() else w if not w.isdigit() else f"d{len(w)}"
            i = self.at[w] = len(self.rows)
            self.rows.append(tuple(map(_h, (low, "s" + shape(w), "a" + low[:2], "b" + low[:3], "c" + low[-2:], "e" + low[-3:], "f" + low[-4:]))))
        return i

    def reset_if_full(self) -> None:
        if len(self.rows) > self.max_kept:
            self.at.clear()
            self.rows.clear()
            self.add("\0")


W, S, P2, P3, E2, E3, E4 = range(7)
# Fixed choices: which properties at which offsets are mixed into one feature.
TEMPLATES: list[tuple[tuple[int, int], ...]] = [
    (), ((0, W),), ((0, S),), ((0, P2),), ((0, P3),), ((0, E2),), ((0, E3),), ((0, E4),),
    ((-1, W),), ((1, W),), ((-2, W),), ((2, W),), ((-3, W),), ((3, W),), ((-1, S),), ((1, S),), ((-2, S),), ((2, S),),
    ((-1, W), (0, W)), ((0, W), (1, W)), ((-1, W), (0, S)), ((0, S), (1, W)), ((-2, W), (-1, W)), ((1, W), (2, W)), ((-2, W), (-1, W), (0, S)), ((0, S), (1, W), (2, W)),
    ((-1, S), (0, S)), ((0, S), (1, S)), ((-1, S), (0, S), (1, S)), ((0, S), (1, S), (2, S)), ((-2, S), (-1, S), (0, S)), ((-2, S), (-1, S), (0, S), (1, S), (2, S)),
    ((0, S), (1, S), (2, S), (3, S), (4, S)), ((-4, S), (-3, S), (-2, S), (-1, S), (0, S)), ((0, S), (1, E3)), ((-1, W), (1, W), (0, S)), ((-1, E3), (0, S)), ((0, E2), (0, S), (1, S)), ((-4, W), (-3, W)), ((-3, W), (0, S)), ((3, W), (0, S)), ((-1, W), (0, S), (1, S), (2, S)), ((-2, W), (-1, W), (0, S), (1, S), (2, S)),
]
REACH = 4


def features(words: Words, ids: np.ndarray, gaps: np.ndarray, pad: np.ndarray) -> np.ndarray:
    """Buckets (tokens x templates).  ``pad`` maps tokens to their place in an array in which
    sequences lie ``REACH`` empty places apart; ``gaps`` tells whether space precedes a token."""
    rows = np.array(words.rows, dtype=np.uint64)
    spread = np.zeros(int(pad[-1]) + REACH + 1 if len(pad) else REACH, dtype=np.int64)
    spread[pad] = ids
    glue = np.zeros(len(spread), dtype=np.uint64)
    glue[pad] = gaps.astype(np.uint64) + 1
    out = np.empty((len(ids), len(TEMPLATES)), dtype=np.int32)
    near = glue[pad] * np.uint64(3) + glue[np.minimum(pad + 1, len(spread) - 1)]
    for k, parts in enumerate(TEMPLATES):
        h = np.full(len(ids), 0x9E3779B9 + 7919 * k, dtype=np.uint64)
        if not parts:
            h = h + near
        for offset, prop in parts:
            h = (h ^ rows[spread[pad + offset], prop]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        if len(parts) > 1 or parts == ((0, S),):
            h = (h ^ near) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        out[:, k] = (h % np.uint64(BUCKETS)).astype(np.int32)
    return out


def prepare(words: Words, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]], np.ndarray]:
    """Features of all tokens, lengths of the sequences, starts of their tokens, word ids."""
    words.reset_if_full()
    ids: list[int] = []
    gaps: list[bool] = []
    lengths, starts = [], []
    for text in texts:
        w, s = tokenize(text)
        ids.extend(map(words.add, w))
        gaps.extend(a == 0 or text[a - 1].isspace() for a in s)
        lengths.append(len(w))
        starts.append(s)
    n = np.array(lengths, dtype=np.int64)
    pad = np.arange(len(ids)) + np.repeat(np.arange(1, len(n) + 1) * REACH, n)
    return features(words, np.array(ids, dtype=np.int64), np.array(gaps, dtype=bool), pad), n, starts, np.array(ids)


def viterbi(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> list[np.ndarray]:
    """Best labels of each sequence; ``scores`` has the tokens of all, one after the other."""
    ends = np.cumsum(lengths)
    out: list[np.ndarray] = [np.empty(0, dtype=np.int8)] * len(lengths)
    order = np.argsort(lengths, kind="stable")
    order = order[np.searchsorted(lengths[order], 1) :]
    at = 0
    while at < len(order):
        longest_allowed = max(1, BLOCK // max(1, int(lengths[order[at]])))
        group = order[at : at + longest_allowed]
        while len(group) > 1 and lengths[group[-1]] > 1.3 * lengths[group[0]] + 4:
            group = group[: max(1, int(np.searchsorted(lengths[group], 1.3 * lengths[group[0]] + 4, side="right")))]
        at += len(group)
        m = int(lengths[group[-1]])
        first = ends[group] - lengths[group]
        best = scores[first]
        back = np.zeros((m, len(group), trans.shape[0]), dtype=np.int8)
        last = np.zeros((len(group),), dtype=np.int64)
        live = lengths[group]
        for t in range(1, m):
            on = live > t
            paths = best[on][:, :, None] + trans[None]
            back[t][on] = paths.argmax(axis=1)
            best[on] = paths.max(axis=1) + scores[first[on] + t]
        last = best.argmax(axis=1)
        labels = np.zeros((m, len(group)), dtype=np.int8)
        who = np.arange(len(group))
        for t in range(m - 1, -1, -1):
            labels[t] = np.where(live > t, last, 0)
            last = np.where((live > t) & (t > 0), back[t, who, last], last)
        for j, g in enumerate(group):
            out[g] = labels[: live[j], j]
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _gradient(scores: np.ndarray, lengths: np.ndarray, gold: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood, by token scores and by transitions."""
    n, k, m = len(lengths), trans.shape[0], int(lengths.max())
    first = np.cumsum(lengths) - lengths
    place = first[:, None] + np.minimum(np.arange(m)[None], (lengths - 1)[:, None])
    live = np.arange(m)[None] < lengths[:, None]
    s, y = scores[place], gold[place]
    alpha, beta = np.zeros((n, m, k)), np.zeros((n, m, k))
    alpha[:, 0] = s[:, 0]
    for t in range(1, m):
        new = _logsum(alpha[:, t - 1][:, :, None] + trans[None], 1) + s[:, t]
        alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
    for t in range(m - 2, -1, -1):
        new = _logsum(trans[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(live[:, t + 1, None], new, 0)
    z = _logsum(alpha[:, -1], 1)
    p = np.exp(alpha + beta - z[:, None, None])
    by_token = -p[live]
    by_token[np.arange(len(by_token)), y[live]] += 1
    by_trans = np.zeros_like(trans)
    for t in range(1, m):
        on = live[:, t]
        if on.any():
            pair = alpha[on, t - 1][:, :, None] + trans[None] + (s[on, t] + beta[on, t])[:, None, :] - z[on, None, None]
            by_trans -= np.exp(pair).sum(axis=0)
            np.add.at(by_trans, (y[on, t - 1], y[on, t]), 1)
    return by_token, by_trans


def gold_labels(starts: list[int], words: list[str], spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(len(starts), dtype=np.int64)
    at = np.array(starts)
    for a, b, c in spans:
        inside = np.flatnonzero((at >= a) & (at < b))
        if len(inside):
            y[inside] = LABELS.index(f"I-{c}")
            y[inside[0]] = LABELS.index(f"B-{c}")
    return y


def train(table: list[tuple[str, list[tuple[int, int, str]]]], passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights (buckets x labels) and transitions (labels x labels)."""
    k, words = len(LABELS), Words()
    table = [(t, s) for t, s in table if t.strip()]
    order = np.argsort([len(t) for t, _ in table], kind="stable")
    table = [table[i] for i in order]  # like lengths together
    feats, lengths, starts, _ = prepare(words, [t for t, _ in table])
    gold = np.concatenate([gold_labels(s, [], spans) for s, (_, spans) in zip(starts, table)])
    used, feats = np.unique(feats, return_inverse=True)
    feats = feats.reshape(len(gold), -1)
    ends = np.cumsum(lengths)
    steps = []
    for a in range(0, len(lengths), STEP_ROWS):
        b = min(a + STEP_ROWS, len(lengths))
        lo, hi = ends[a] - lengths[a], ends[b - 1]
        f = feats[lo:hi]
        flat = f.ravel()
        by = np.argsort(flat, kind="stable")
        here, first = np.unique(flat[by], return_index=True)
        steps.append((lengths[a:b], gold[lo:hi], f, by // f.shape[1], here, first))
    w, gw = np.zeros((len(used), k)), np.full((len(used), k), 1e-3)
    tr, gt = np.zeros((k, k)), np.full((k, k), 1e-3)
    rng = np.random.default_rng(0)
    for _ in range(passes):
        for i in rng.permutation(len(steps)):
            n, y, f, token, here, first = steps[i]
            by_token, by_trans = _gradient(w[f].sum(axis=1), n, y, tr)
            g = np.add.reduceat(by_token[token], first, axis=0) - DECAY * w[here]
            gw[here] += g * g
            w[here] += RATE * g / np.sqrt(gw[here])
            gt += by_trans * by_trans
            tr += RATE * by_trans / np.sqrt(gt)
    every = np.zeros((BUCKETS, k), dtype=np.float32)
    every[used] = w
    for i, a in enumerate(LABELS):  # I-x follows B-x and I-x only
        for j, b in enumerate(LABELS):
            if b[0] == "I" and a[1:] != b[1:]:
                tr[i, j] = -1e4
    return every, tr.astype(np.float32)


def tag(words: Words, weights: np.ndarray, trans: np.ndarray, texts: Sequence[str]) -> list[list[tuple[int, int, str]]]:
    """Spans ``(start, end, category)`` in code points of each text, in order."""
    out: list[list[tuple[int, int, str]]] = []
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= 4 * BLOCK):
            chars += len(texts[j])
            j += 1
        part = texts[i:j]
        feats, lengths, starts, _ = prepare(words, part)
        scores = np.zeros((len(feats), len(LABELS)), dtype=np.float32)
        for col in feats.T:
            scores += weights[col]
        if len(scores):
            first = (np.cumsum(lengths) - lengths)[lengths > 0]
            scores[first[:, None], np.arange(2, len(LABELS), 2)[None]] -= 1e4  # no sequence starts inside a span
        for text, s, y in zip(part, starts, viterbi(scores, lengths, trans)):
            spans: list[list] = []
            for a, l in zip(s, y):
                if l == 0:
                    continue
                name = LABELS[l]
                if name[0] == "B" or not spans:
                    spans.append([a, a, name[2:]])
                m = _TOKEN.match(text, a)
                spans[-1][1] = m.end()
            out.append([tuple(x) for x in spans])
        i = j
    return out
