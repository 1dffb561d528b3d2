"""Category registries and predicates on tokens such as ``[EMAIL_0]``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismveil.functions.patterns import LOCALES

# The registries.
REGEX = frozenset("EMAIL SSN CREDIT_CARD PHONE IP_ADDRESS API_KEY AWS_KEY JWT IBAN IL_ID DATE AGE_90PLUS MRN ACCOUNT_NUMBER HEALTH_PLAN_ID LICENSE_NUMBER NPI MEDICARE_MBI HICN DEA SSN_PARTIAL ZIP STREET_ADDRESS".split())
NER = frozenset("PERSON ORG GPE FAC NORP MISC".split())
LLM = frozenset("ADDRESS DATE_OF_BIRTH MEDICAL FINANCIAL NATIONAL_ID BIOMETRIC USERNAME PASSWORD VEHICLE".split())
SPECIAL = frozenset("RACE ETHNICITY RELIGION POLITICAL_OPINION HEALTH_BIOMETRIC SEXUAL_ORIENTATION TRADE_UNION GENETIC".split())
LOCALE = frozenset(name.lstrip("!") for rules in LOCALES.values() for name, _ in rules)
BUILTIN = REGEX | NER | LLM | SPECIAL | LOCALE
OPT_IN = frozenset("DATE AGE_90PLUS MRN ACCOUNT_NUMBER HEALTH_PLAN_ID LICENSE_NUMBER NPI MEDICARE_MBI HICN DEA SSN_PARTIAL ZIP STREET_ADDRESS".split())
RESERVED = BUILTIN - OPT_IN

TOKEN_PATTERN = r"\[([A-Z][A-Z0-9_]*_(?:\d+|REDACTED))\]"
MAX_TOKEN_LENGTH = 40
ESCAPED_OPEN, ESCAPED_CLOSE = "［", "］"

_TOKEN = re.compile(TOKEN_PATTERN, re.A)
_PARTS = re.compile(r"\[([A-Z][A-Z0-9_]*)_(\d+|REDACTED)\]", re.A)
_NAME = re.compile(r"[A-Z][A-Z0-9_]*", re.A)


def valid_token(token: str) -> bool:
    return len(token) <= MAX_TOKEN_LENGTH and _TOKEN.fullmatch(token) is not None


def parse_token(token: str) -> tuple[str, str] | None:
    m = _PARTS.fullmatch(token)
    return (m.group(1), m.group(2)) if m else None


def redacted_token(token: str) -> bool:
    return (parse_token(token) or ("", ""))[1] == "REDACTED"


def valid_category(name: str) -> bool:
    return _NAME.fullmatch(name) is not None


def token_columns(token: Column) -> dict[str, Column]:
    """The predicates as columns: ``is_token``, ``category``, ``suffix``, ``is_redacted``."""
    parts = r"\A\[([A-Z][A-Z0-9_]*)_([0-9]+|REDACTED)\]\z"
    ok = (F.length(token) <= MAX_TOKEN_LENGTH) & token.rlike(parts)
    return {
        "is_token": F.coalesce(ok, F.lit(False)),
        "category": F.when(ok, F.regexp_extract(token, parts, 1)),
        "suffix": F.when(ok, F.regexp_extract(token, parts, 2)),
        "is_redacted": F.coalesce(ok & token.rlike(r"_REDACTED\]\z"), F.lit(False)),
    }


def registry(spark: SparkSession) -> DataFrame:
    """``name, family, opt_in, reserved`` of every built-in category."""
    families = (("regex", REGEX), ("ner", NER), ("llm", LLM), ("special", SPECIAL), ("locale", LOCALE))
    rows = [(n, f, n in OPT_IN, n in RESERVED) for f, names in families for n in sorted(names)]
    return spark.createDataFrame(rows, "name string, family string, opt_in boolean, reserved boolean")
