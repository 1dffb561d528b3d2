"""Documents with template residue, filler, error pages or notices in place of content.

1. A text is cut into fields (title, section bodies, numbered paragraphs and claims) and the
   fields into sentences; every task mines its sentences into templates (see ``templates``).
2. The templates of all tasks are merged, spread by hash first and by leaf of the tree second; each
   merged template is classified once: junk, page furniture or content.  The classifier is a
   softmax regression over hashed character and word n-grams, trained at the start of the query
   on the labelled lines of ``junk_labels`` (that table is its bound).
3. Verdicts go back to the fields by template number.  A field is junk if it has a junk sentence
   and all its others are junk or furniture; a document with such a field is a case.
4. Apart from that, a placeholder in template syntax that stands outside the sentences of an
   ordinary field (before its first or in brackets after its last) is an unresolved slot.

A notice below the last claim belongs to a field with content and is no case.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismveil.llm import junk_labels, templates
from prismveil.llm.encoding import slices

#: Hash buckets of the classifier, its passes over the labelled lines, rate and decay.
BUCKETS, PASSES, RATE, DECAY = 1 << 16, 300, 120.0, 1e-5
JUNK, CHROME, CONTENT = 0, 1, 2
#: Share of the tokens of a template that must not be wildcards for a verdict other than content.
MIN_FIXED = 0.5
#: Added to the score of content: what no labelled line resembles is content.
PRIOR = 1.5
#: Junk templates whose numbers may be broadcast (16 bytes each).
MAX_BROADCAST = 1_000_000

# Headings of the sections of a patent.
HEADINGS = (
    "Abstract", "ABSTRACT", "(57) Abstract:", "Detailed Description", "DESCRIPTION", "Description", "DETAILED DESCRIPTION OF EMBODIMENTS", "CLAIMS", "Claims", "We claim:", "What is claimed is:",
    "Zusammenfassung", "ZUSAMMENFASSUNG", "Beschreibung", "BESCHREIBUNG", "Ansprüche", "PATENTANSPRÜCHE", "Patentansprüche",
    "ABRÉGÉ", "Abrégé", "REVENDICATIONS", "Revendications", "RESUMEN", "Resumen", "DESCRIPCIÓN", "Descripción", "REIVINDICACIONES", "Reivindicaciones",
    "摘要", "说明书", "权利要求书", "【要約】", "【発明の詳細な説明】", "【特許請求の範囲】", "【書類名】要約書",
)
_FOLD = re.compile(r"[\W_]+")
_SYNTAX = re.compile(r"[$@{}<>%«»\[\]]|__")


def _fold(line: str) -> str:
    return _FOLD.sub("", line).casefold()


_FOLDED = {_fold(h) for h in HEADINGS}
_LETTERS = [(h, set(h)) for h in sorted(_FOLDED) if len(h) >= 5]
_LONGEST = max(map(len, _FOLDED))
_INLINE = re.compile(r"(?:(?<=\s)|^)(" + "|".join(sorted(map(re.escape, HEADINGS), key=len, reverse=True)) + r")(?=\s|$|【|\[)")
_MARK = re.compile(r"\s*(?:\[\d{1,5}\]|【\d{1,5}】|【請求項\d+】|(?:Claim|Anspruch|Revendication|Reivindicación) \d{1,3}\s*:|\d{1,3}\s*[.):、](?=\s|\D))\s*")
_INLINE_MARK = re.compile(r"(?<=\s)(?=\[\d{4}\]\s|【\d{4}】|【請求項\d+】|Claim \d{1,3}: )")
_STOP = re.compile(r"[.!?…。！？](?:\s+(?=[A-ZÄÖÜÉÁÍÓÚ¿¡0-9\[<{%@$_«(])|(?<=[。！？]) *)")


def sentences(line: str) -> list[str]:
    out, at = [], 0
    for m in _STOP.finditer(line):
        out.append(line[at : m.start() + 1])
        at = m.end()
    if at < len(line):
        out.append(line[at:])
    return out


def _near(a: str, b: str) -> bool:
    """At most two single-character errors apart (short words: one), as scanning leaves them."""
    allowed = 1 if len(b) < 8 else 2
    if abs(len(a) - len(b)) > allowed:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= allowed


def is_heading(line: str) -> bool:
    return len(line) <= _LONGEST + 12 and _is_heading(line)


@lru_cache(maxsize=100_000)
def _is_heading(line: str) -> bool:
    if _SYNTAX.search(line):
        return False
    f = _fold(line)
    if f in _FOLDED:
        return True
    if not 5 <= len(f) <= _LONGEST + 2 or len(line) > len(f) + 12:
        return False
    chars = set(f)  # two errors change at most four members of the set
    return any(len(chars ^ c) <= 4 and _near(f, h) for h, c in _LETTERS)


def _unflattened(text: str) -> str:
    """A text whose line breaks were lost, with breaks before headings, marks and claims."""
    text = _INLINE.sub(r"\n\1\n", text)
    text = _INLINE_MARK.sub("\n", text)
    out = []
    for part in text.split("\n"):
        n, at = 1, 0
        while True:  # numbered claims follow each other from 1
            m = re.compile(rf"(?:^|(?<=\s)){n}(?:[.)] |、)").search(part, at)
            if m is None or (n == 1 and m.start() > 3):
                out.append(part[at:])
                break
            out.append(part[at : m.start()])
            at, n = m.start(), n + 1
    return "\n".join(out)


def fields(text: str) -> list[list[str]]:
    """Lines of each field of a text, without marks, headings and blank lines."""
    text = text.replace("﻿", "").replace("\xad", "").replace("\r\n", "\n").replace("\r", "\n")
    flat = text.strip().count("\n") < 2 and len(text) > 60
    if flat:
        text = _unflattened(text)
    out: list[list[str]] = [[]]
    any_heading = False
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        if is_heading(line):
            any_heading = True
            out.append([])
            continue
        m = _MARK.match(line)
        if m and m.end() < len(line):
            out.append([])
            line = line[m.end() :]
        elif m and m.end() == len(line) and line[-1] in "]】":
            out.append([])
            continue
        out[-1].extend(sentences(line))
    if not any_heading and len(out) == 1 and len(out[0]) > 1 and len(out[0][0]) <= 60:
        out.append(out[0][1:])  # a title and the rest
        out[0] = out[0][:1]
    return [f for f in out if f]


_PHRASE = "|".join(re.escape(x) for x in ("[●]", "【ここに記載】", "○○○○を入力してください", "【请在此处填写】", "（待补充）", "<hier Text eingeben>", "[insérer le texte ici]", "<à compléter>", "[insertar texto aquí]", "<por completar>", "(to be completed by the applicant)", "[Bezeichnung der Erfindung einfügen]")) + r"|\[TBD[^\]\n]{0,40}\]"
_ANY = f"(?:{templates.SLOT.pattern}|{_PHRASE})"
_BEFORE = re.compile(rf"\s*{_ANY}\s*(?:(?=[A-ZÄÖÜÉÈÀÁÍÓÚÑÇ\d¿¡])|(?=[぀-ヿ㐀-鿿가-힯])|(?=[a-z]+ [a-z]+ [a-z]))(?!and |or |und |oder |et |ou |y |o |is |are |wird |est |se |と|和|或|は|を|が)")
_AFTER = re.compile(rf"[.。!?\w)\]}}$…;,:|]\s?[(（]{_ANY}[)）]\s*$")
_ALONE = re.compile(rf"[(（]?\s*{_ANY}\s*[)）]?[.。]?")


def has_slot(field: list[str]) -> bool:
    """Does an ordinary field carry a placeholder outside its sentences?"""
    for s in field:
        c = s[0]
        if c in "{<[$#%@_«【（○(" and (_ALONE.fullmatch(s) or _BEFORE.match(s)):
            return True
        if s[-1] in ")）" and _AFTER.search(s):
            return True
    return False


# ---- classifier ------------------------------------------------------------------------


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


@lru_cache(maxsize=100_000)
def _of_word(w: str) -> tuple[int, ...]:
    if w[0] == "<":
        return (_bucket(f"w{w}"),)
    edged = f"^{w}$"
    return (_bucket(f"w{w}"), *{_bucket(edged[i : i + n]) for n in (3, 4, 5) for i in range(len(edged) - n + 1)})


def features(line: str) -> np.ndarray:
    """Buckets of the words, word pairs and character 3- to 5-grams of a line, repeats once."""
    words = [w.casefold() for w in templates.tokens(line)]
    grams = {_bucket(f"p{a} {b}") for a, b in zip(["^", *words], [*words, "$"])}
    for w in words:
        grams.update(_of_word(w))
    upper = sum(map(str.isupper, line))
    if upper > 0.6 * sum(map(str.isalpha, line)) > 0:
        grams.add(_bucket("!upper"))
    if len(words) >= 4 and len(set(words)) <= 0.4 * len(words):
        grams |= {_bucket("!repeats"), _bucket("!repeats2")}
    return np.fromiter(grams, dtype=np.int64)


def train() -> np.ndarray:
    """Weights (buckets + bias, classes) by full-batch gradient ascent on the labelled lines."""
    rows, y = [], []
    for label, block in ((JUNK, junk_labels.JUNK), (CHROME, junk_labels.CHROME), (CONTENT, junk_labels.CONTENT)):
        for line in junk_labels.lines(block):
            for sentence in sorted({line, *sentences(line)}):
                for variant in sorted({sentence, sentence.upper()}) if label == JUNK else [sentence]:
                    rows.append(features(templates.mask(variant)))
                    y.append(label)
    at = np.concatenate(rows)
    size = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    value = np.repeat(1 / np.sqrt(np.maximum(size, 1)), size)
    target = np.eye(3)[y]
    used, at = np.unique(at, return_inverse=True)
    starts = np.cumsum([0, *size[:-1]])
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(len(used)))
    w = np.zeros((len(used), 3))
    bias = np.zeros(3)
    for _ in range(PASSES):
        score = np.add.reduceat(w[at] * value[:, None], starts) + bias
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        err = (target - p) / len(rows)
        step = np.add.reduceat((err[row] * value[:, None])[order], first)
        w += RATE * (step - DECAY * w)
        bias += err.sum(axis=0)
    bias[CONTENT] += PRIOR
    every = np.zeros((BUCKETS + 1, 3), dtype=np.float32)
    every[used], every[-1] = w, bias
    return every


def classify(weights: np.ndarray, template: str) -> int:
    words = template.split(" ")
    fixed = [w for w in words if w != templates.WILD]
    if len(fixed) < MIN_FIXED * len(words):
        return CONTENT  # too little of the template is known to speak against its lines
    f = features(" ".join(fixed))
    if not len(f):
        return CHROME
    return int((weights[f].sum(axis=0) / np.sqrt(len(f)) + weights[-1]).argmax())


# ---- operator --------------------------------------------------------------------------

_LINES = T.ArrayType(T.StructType([T.StructField("f", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("t", T.LongType())]))


def mined(df: DataFrame, key: str, text: str) -> DataFrame:
    """Documents and the templates of the tasks that read them, in one table.

    A document has ``_key``, ``_slot`` (an unresolved slot inside a field) and ``_lines`` (field,
    lines of that field, template of each line); a template has its number ``_t`` and ``_text``.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("_key", kind), T.StructField("_slot", T.BooleanType()), T.StructField("_lines", _LINES), T.StructField("_t", T.LongType()), T.StructField("_text", T.StringType()), T.StructField("_n", T.LongType())])
    lines_type = pa.list_(pa.struct([("f", pa.int32()), ("n", pa.int32()), ("t", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, base, key_type = templates.Tree(), TaskContext.get().partitionId() << 32, None
        for part in slices(batches):
            key_type = part.schema.field(0).type
            slot, ends, number, size, place = [], [0], [], [], []
            for t in part.column(1).to_pylist():
                found, cut = False, fields(t)
                for i, field in enumerate(cut):
                    found = found or has_slot(field)
                    number.extend([i] * len(field))
                    size.extend([len(field)] * len(field))
                    place.extend(map(tree.add, field))
                slot.append(found)
                ends.append(len(place))
            n = len(slot)
            structs = pa.StructArray.from_arrays([pa.array(number, pa.int32()), pa.array(size, pa.int32()), pa.array(np.array(place, dtype=np.int64) + base)], fields=list(lines_type.value_type))
            every = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(slot), every, pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=schema.names)
        if key_type is not None and tree.templates:
            n = len(tree.templates)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, key_type), pa.nulls(n, pa.bool_()), pa.nulls(n, lines_type), pa.array(range(base, base + n), pa.int64()), pa.array([tree.text(i) for i in range(n)]), pa.array(tree.counts, pa.int64())],
                names=schema.names,
            )

    blank = F.coalesce(F.length(F.trim(text)) == 0, F.lit(True))
    return df.filter(~blank).select(df[key].alias("_key"), df[text].alias("_text")).mapInArrow(run, schema)


def _merge(parts: DataFrame) -> DataFrame:
    """``(_local, _now, _n)`` with ``_now`` merged inside each partition of ``parts``, the most
    frequent first; ``_local`` is the template as its task left it."""
    schema = "_local string, _now string, _n long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, held = templates.Tree(), []
        for b in batches:
            held.append((b[["_local", "_n"]], [tree.add_template(t, int(n)) for t, n in zip(b["_now"], b["_n"])]))
        for b, at in held:
            yield b.assign(_now=[tree.text(a) for a in at])[["_local", "_now", "_n"]]

    return parts.sortWithinPartitions(F.desc("_n"), "_now", "_local").mapInPandas(run, schema)


def merged_templates(templates_: DataFrame) -> DataFrame:
    """``(_local, _now, _n)`` for the distinct templates of all tasks.

    First merged wherever their hash sends them, so that a full leaf is thinned by many tasks;
    then leaf by leaf.
    """
    distinct = templates_.groupBy(F.col("_text").alias("_local")).agg(F.sum("_n").alias("_n")).withColumn("_now", F.col("_local"))
    words = F.split("_now", " ", -1)
    leaf = F.xxhash64(F.size(words), *[F.get(words, F.lit(i)) for i in range(templates.DEPTH)])
    return _merge(_merge(distinct).repartition(leaf))


def template_verdicts(merged: DataFrame) -> DataFrame:
    """``(_local, _now, _n, verdict)``: 0 junk, 1 furniture, 2 content, by merged template."""
    weights = train()

    @F.pandas_udf(T.IntegerType())
    def verdict(now: pd.Series) -> pd.Series:
        return now.map(lambda t: classify(weights, t)).astype("int32")

    once = merged.select("_now").distinct().withColumn("verdict", verdict("_now"))
    return merged.join(once, "_now")


def junk_documents(stored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``_key, reason`` of the cases from stored results of ``mined`` and ``template_verdicts``.

    Defined results: null, empty and blank texts are no cases; repeated keys are one case; a
    null key is a key; a text of any length is cut whole; an empty table has none.
    """
    marked = verdicts.filter(F.col("verdict") != CONTENT).select(F.col("_local").alias("_text"), "verdict")
    numbers = stored.filter(F.col("_t").isNotNull()).select("_t", "_text").join(marked, "_text").select(F.col("_t").alias("t"), "verdict")
    docs = stored.filter(F.col("_t").isNull())
    lines = docs.select("_key", F.explode("_lines").alias("l")).select("_key", "l.f", "l.n", "l.t")
    small = numbers.count() <= MAX_BROADCAST
    fields_ = (
        lines.join(F.broadcast(numbers) if small else numbers, "t")
        .groupBy("_key", "f", "n")
        .agg(F.count(F.lit(1)).alias("bad"), F.count(F.when(F.col("verdict") == JUNK, 1)).alias("junk"))
        .filter((F.col("junk") > 0) & (F.col("bad") >= F.col("n")))
    )
    whole = fields_.select("_key", F.lit("field").alias("reason"))
    slots = docs.filter("_slot").select("_key", F.lit("slot").alias("reason"))
    return whole.unionByName(slots).groupBy("_key").agg(F.min("reason").alias("reason"))
