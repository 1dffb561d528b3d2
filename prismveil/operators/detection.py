"""Spans of sensitive text: an ordered program of patterns, each behind its gates.

Order is precedence: a claimed span blocks every later match that overlaps it, a rejected
candidate claims nothing, and after either the scan goes on behind the match.  The program runs
per text in Arrow batches; counts of one category alone are native expressions.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismveil.functions import categories, gates
from prismveil.functions import patterns as P

#: CPU seconds that a custom or locale pattern, and a built-in one, may take on hostile strings.
CUSTOM_BUDGET, BUILTIN_BUDGET = 0.1, 1.0

DETECTION = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", T.StringType()),
    ]
)
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("category", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("source", pa.string())]))


@dataclass(frozen=True)
class Detection:
    text: str
    category: str
    start: int
    end: int
    confidence: float
    source: str


class Covered:
    """Claimed spans, none of which overlap, in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def blocks(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return (i > 0 and self.ends[i - 1] > start) or (i < len(self.starts) and self.starts[i] < end)

    def claim(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


class Backend(ABC):
    """One detection pass.  It must claim what it returns; instances travel to the workers."""

    name = "backend"

    @abstractmethod
    def detect(self, text: str, covered: Covered) -> list[Detection]: ...


@dataclass(frozen=True)
class Config:
    """What the program detects.  ``switches`` overrules the default of a switch by its name;
    ``custom`` are ``(name, pattern)`` and come first; ``locale`` adds a locale's patterns."""

    switches: dict[str, bool] = field(default_factory=dict)
    custom: tuple[tuple[str, str], ...] = ()
    locale: str = "en"
    max_input_length: int = 1_000_000

    def __post_init__(self) -> None:
        known = {s for _, s, _, _ in P.BUILTIN}
        if unknown := set(self.switches) - known:
            raise ValueError(f"unknown switches: {sorted(unknown)}")
        if self.locale != "en" and self.locale not in P.LOCALES:
            raise ValueError(f"unknown locale {self.locale!r}")
        if self.max_input_length < 0:
            raise ValueError("max_input_length must not be negative")
        for name, _ in self.custom:
            if not categories.valid_category(name):
                raise ValueError(f"{name!r} is no category name")


class RegexBackend(Backend):
    """The patterns of a configuration, custom ones first, then the locale's, then built-in."""

    name = "regex"

    def __init__(self, config: Config = Config(), probe: bool = False) -> None:
        self.rules: list[tuple[str, re.Pattern, str]] = []
        self.skipped: list[str] = []
        for name, pattern in config.custom:
            compiled = re.compile(pattern)
            if compiled.match("") or compiled.search("", 0):
                raise ValueError(f"pattern {name} matches the empty text")
            self._add(name, compiled, "custom", probe)
        for name, pattern in P.LOCALES.get(config.locale, ()):
            flags = re.A | (re.I if name[0] == "!" else 0)
            self._add(name.lstrip("!"), re.compile(pattern, flags), "locale", probe)
        for name, switch, default, pattern in P.BUILTIN:
            if config.switches.get(switch, default):
                self._add(name, re.compile(pattern, re.A), "builtin", probe)

    def _add(self, name: str, pattern: re.Pattern, origin: str, probe: bool) -> None:
        if probe:
            took = gates.probe_seconds(pattern)
            if origin == "builtin" and took >= BUILTIN_BUDGET:
                raise ValueError(f"pattern {name} takes {took:.1f} s on hostile text")
            if origin != "builtin" and took > CUSTOM_BUDGET:
                self.skipped.append(name)
                return
        self.rules.append((name, pattern, origin))

    @staticmethod
    def _span(name: str, origin: str, text: str, m: re.Match) -> tuple[str, int, int] | None:
        """Category and span of a match; None if its name is none."""
        start, end = m.span()
        if origin == "builtin" and name in P.VALUE_ONLY:
            return name, m.start(1), m.end(1)
        if origin == "builtin" and name in P.ROLE_NAMES:
            start = next(m.start(i) for i in range(1, m.re.groups + 1) if m.start(i) >= 0)
            kept = gates.trimmed_name(text, start, end)
            return None if kept is None else ("PERSON", start, kept)
        return name, start, end

    @staticmethod
    def _accepted(name: str, origin: str, text: str, start: int, end: int, whole: str) -> bool:
        if origin != "custom":
            if origin == "builtin" and name in P.HEALTH_IDS and not gates.health_id(name, text, start, end):
                return False
            if gates.inside_decimal(text, start, end) and not (name.startswith("PHONE") and gates.phone_context(text, start)):
                return False
            if name == "DATE" and not gates.date(text, start, end):
                return False
            if name == "AGE_90PLUS" and not gates.age_over_89(text, start, end):
                return False
        if name == "PHONE" and not gates.phone(text, start, end):
            return False
        return name != "CREDIT_CARD" or gates.luhn(whole)

    def detect(self, text: str, covered: Covered) -> list[Detection]:
        found = []
        for name, pattern, origin in self.rules:
            for m in pattern.finditer(text):
                at = self._span(name, origin, text, m)
                if at is None or m.start() == m.end():
                    continue
                category, start, end = at
                if covered.blocks(start, end) or not self._accepted(name, origin, text, start, end, m.group()):
                    continue
                covered.claim(start, end)
                found.append(Detection(text[start:end], category, start, end, 0.95, "regex"))
        return found


class CallableBackend(Backend):
    """A model behind a callable (named entities, a language model): text -> (value, category)
    pairs or spans.  Values are looked up literally, longest first; any error gives nothing, as
    a detector that is not there, unless it is ``required``."""

    def __init__(self, name: str, find: Callable[[str], Sequence[tuple]], confidence: float = 0.8, excluded: frozenset[str] = frozenset(), required: bool = False) -> None:
        self.name, self.find, self.confidence, self.excluded, self.required = name, find, confidence, excluded, required

    def detect(self, text: str, covered: Covered) -> list[Detection]:
        try:
            answers = list(self.find(text))
        except Exception:
            if self.required:
                raise
            return []
        spans = []
        for value, category, *span in sorted(answers, key=lambda a: -len(a[0])):
            category = category.upper()
            if category in self.excluded or len(value) < 2:
                continue
            if span:
                spans.append((span[0], gates.with_surname(text, *span) if category == "PERSON" else span[1], category))
                continue
            at = text.find(value)
            while at >= 0:
                spans.append((at, at + len(value), category))
                at = text.find(value, at + len(value))
        found = []
        for start, end, category in spans:
            if not covered.blocks(start, end):
                covered.claim(start, end)
                found.append(Detection(text[start:end], category, start, end, self.confidence, self.name))
        return found


class Engine:
    """Passes in order over shared claims; the result is ordered by position."""

    def __init__(self, backends: Sequence[Backend] | None = None, config: Config = Config()) -> None:
        self.backends = list(backends) if backends is not None else [RegexBackend(config)]
        self.config = config

    def detect(self, text: str) -> list[Detection]:
        cap = self.config.max_input_length
        if cap and len(text) > cap:
            raise ValueError(f"text of {len(text)} characters exceeds max_input_length {cap}")
        covered, found = Covered(), []
        for b in self.backends:
            found.extend(b.detect(text, covered))
        return sorted(found, key=lambda d: d.start)


#: Texts without any of these hold nothing of the default categories.
_MAYBE = r"[0-9@]|:[A-Fa-f0-9]{0,4}:|eyJ|AKIA|ASIA|(?:sk|pk|api|key|token|secret|bearer)[-_]?[A-Za-z0-9_-]{20}"


def with_detections(df: DataFrame, text: str, engine: Engine | None = None, out: str = "detections") -> DataFrame:
    """``df`` with an array of detections in ``text``, offsets in code points, in order.

    Defined results: null, empty and blank texts have none (an empty array); an existing column
    ``out`` is replaced.  With the default program, texts that cannot hold any category are not
    sent through it.
    """
    default = engine is None
    engine = engine or Engine()
    maybe = re.compile(_MAYBE)
    kept = df.drop(out) if out in df.columns else df
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(DETECTION))])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(at).to_pylist():
                skip = not t or t.isspace() or (default and maybe.search(t) is None)
                rows.append([] if skip else [d.__dict__ for d in engine.detect(t)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, _ARROW)], names=schema.names)

    return kept.mapInArrow(run, schema)


def detections(df: DataFrame, keys: Sequence[str], text: str, engine: Engine | None = None) -> DataFrame:
    """One row per detection: ``keys`` and the fields of a detection, the fact table of spans."""
    found = with_detections(df.select(*keys, text), text, engine, "_d")
    return found.select(*keys, F.explode("_d").alias("_d")).select(*keys, *[F.col(f"_d.{f}").alias(f"{f}_" if f in keys else f) for f in DETECTION.names])


# ---- one category, native --------------------------------------------------------------

_BEFORE, _AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Patterns for the JVM, with ASCII word borders spelled out.
NATIVE = {
    "EMAIL": _BEFORE + r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}" + _AFTER,
    "IPV4": _BEFORE + r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)" + _AFTER,
    "IBAN": _BEFORE + r"[A-Z]{2}[0-9]{2}(?:\s?[0-9A-Z]{4}){2,7}(?:\s?[0-9A-Z]{1,4})?" + _AFTER,
    "API_KEY": _BEFORE + r"(?:sk|pk|api|key|token|secret|bearer)[-_]?[a-zA-Z0-9_-]{20,512}" + _AFTER,
    "AWS_KEY": _BEFORE + r"(?:AKIA|ASIA)[A-Z0-9]{16}" + _AFTER,
    "JWT": _BEFORE + r"eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}" + _AFTER,
}


def count_matches(text: Column, category: str) -> Column:
    """Number of matches of a native pattern; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(NATIVE[category])), F.lit(0)).cast("bigint")


def redact_matches(text: Column, category: str, token: str) -> Column:
    return F.regexp_replace(text, NATIVE[category], token)


def matches(text: Column, category: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(NATIVE[category]), F.lit(0)), F.array().cast("array<string>"))


def luhn_valid(value: Column) -> Column:
    """Mod-10 over the digits of ``value``, at least twelve; null gives false."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.coalesce((F.length(digits) >= 12) & F.call_function("luhn_check", digits), F.lit(False))
