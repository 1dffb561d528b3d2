"""Checks behind the patterns: a pattern proposes, a gate decides.  Pure functions of a text
and a span ``[start, end)``."""

from __future__ import annotations

import re

from prismveil.functions import patterns as P

_WORD = re.compile(r"[A-Za-z]+(?:['-][A-Za-z]+)?")
_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_LONGEST = {1: 31, 2: 29, 3: 31, 4: 30, 5: 31, 6: 30, 7: 31, 8: 31, 9: 30, 10: 31, 11: 30, 12: 31}


def _before(text: str, start: int, width: int) -> str:
    return text[max(0, start - width) : start]


def luhn(value: str, least: int = 12) -> bool:
    """Mod-10 check over the digits of ``value``, of which there must be ``least``."""
    digits = [int(c) for c in value if c in "0123456789"]
    if len(digits) < least:
        return False
    doubled = (2 * d - 9 if d > 4 else 2 * d for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def npi(value: str) -> bool:
    """US provider number: mod-10 with the issuer prefix 80840."""
    return re.fullmatch(r"[12]\d{9}", value, re.A) is not None and luhn("80840" + value)


def dea(value: str) -> bool:
    if re.fullmatch(r"[A-Z][A-Z9]\d{7}", value, re.A) is None:
        return False
    d = [int(c) for c in value[2:]]
    return (sum(d[0:5:2]) + 2 * sum(d[1:6:2])) % 10 == d[6]


def inside_decimal(text: str, start: int, end: int) -> bool:
    """Is the span part of digits, one dot, digits?  A dot that ends the sentence is no part."""
    numeric = "0123456789."
    while start > 0 and text[start - 1] in numeric:
        start -= 1
    while end < len(text) and text[end] in numeric:
        end += 1
    return re.fullmatch(r"\d+\.\d+", text[start:end].rstrip("."), re.A) is not None


def phone_context(text: str, start: int) -> bool:
    return P.PHONE_CONTEXT.search(_before(text, start, 28)) is not None


def phone(text: str, start: int, end: int) -> bool:
    """Seven digits at least; a run of digits only also needs a phone word before it."""
    value = text[start:end]
    if len(re.sub(r"[-.\s()+]", "", value)) < 7:
        return False
    return re.fullmatch(r"\d+", value, re.A) is None or phone_context(text, start)


def health_id(category: str, text: str, start: int, end: int) -> bool:
    value = text[start:end]
    if category in ("MRN", "ACCOUNT_NUMBER", "HEALTH_PLAN_ID", "LICENSE_NUMBER"):
        return sum(c in "0123456789" for c in value) >= 5
    if category == "NPI":
        return npi(value)
    if category == "DEA":
        return dea(value)
    if category == "MEDICARE_MBI":
        return value.count("-") == 2 or P.MEDICARE_CONTEXT.search(_before(text, start, 40)) is not None
    return True


def month_day(value: str) -> tuple[int | None, int | None]:
    numbers = [int(n) for n in re.findall(r"\d+", value)]
    word = re.search(r"[A-Za-z]{3,}", value)
    if word:
        day = next((n for n in numbers if n <= 31), None)
        return _MONTHS.get(word.group()[:3].lower()), day
    if re.match(r"(?:19|20)\d{2}[-/]", value):
        return numbers[1], numbers[2]
    if len(numbers) == 2 and numbers[1] >= 1900:
        return numbers[0], None
    return numbers[0], numbers[1]


def date(text: str, start: int, end: int) -> bool:
    """A month and day that exist; digits only: no ratio, and without a year a date word before."""
    value = text[start:end]
    month, day = month_day(value)
    if month not in _LONGEST or (day is not None and not 1 <= day <= _LONGEST[month]):
        return False
    if re.search(r"[A-Za-z]", value):
        return True
    if P.RATIO_AFTER.match(text, end):
        return False
    with_year = re.search(r"\d+\D+\d+\D+\d+|(?:19|20)\d{2}", value) is not None
    return with_year or P.DATE_CONTEXT.search(_before(text, start, 22)) is not None


def age_over_89(text: str, start: int, end: int) -> bool:
    if P.TEMPERATURE_BEFORE.search(_before(text, start, 8)):
        return False
    first = re.search(r"\d+", text[start:end])
    return first is None or int(first.group()) >= 90


def trimmed_name(text: str, start: int, end: int) -> int | None:
    """End of the name without trailing words that are no surname; None if it holds a stop word."""
    words = [(m.group(), start + m.end()) for m in _WORD.finditer(text[start:end])]
    while words and words[-1][0] in P.NO_SURNAMES:
        words.pop()
    if not words or any(w in P.STOP_WORDS for w, _ in words):
        return None
    return words[-1][1]


def with_surname(text: str, start: int, end: int) -> int:
    """End of a first name extended over the surname right behind it."""
    if " " in text[start:end].strip():
        return end
    m = P.SURNAME_AFTER.match(text, end)
    return end if m is None or m.group(1) in P.NO_SURNAMES else m.end()


def probe_seconds(pattern: re.Pattern) -> float:
    """CPU seconds of a pattern on ten hostile strings."""
    import time

    n = 2000
    hostile = ["a" * n, "1" * n, " " * n, "a1" * n, "-" * n, "(" * n, "a." * n, "1 " * n, "A" * n + "!", "9" * 50 + "X"]
    began = time.process_time()
    for text in hostile:
        for _ in pattern.finditer(text):
            pass
    return time.process_time() - began
