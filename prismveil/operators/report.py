"""A compliance report from a log of raw lines: rollups and chain errors, as JSON and Markdown."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismveil.operators import audit_chain, compliance

#: Errors of the chain that a report names; all are counted.
NAMED_ERRORS = 20

ENTRY = (
    "seq bigint, event_id string, timestamp string, event_type string, model string, provider string, entity_count bigint, categories map<string,bigint>, certificate_hash string, key_id string, "
    "decision_id string, article_ref array<string>, compliance_version string, pii_in_log boolean, bias_context struct<wipe_confirmed:boolean>, content_context struct<modality:string,synthetic:boolean,labeled:boolean,deepfake:boolean>"
)


def typed(lines: DataFrame) -> DataFrame:
    """The entries of raw lines with the columns that rollups need; lines that are no JSON object
    are left out."""
    return lines.select(F.from_json("raw", ENTRY, {"mode": "PERMISSIVE"}).alias("e"), F.expr("schema_of_variant(try_parse_json(raw))").alias("_k")).filter(F.col("_k").startswith("OBJECT")).select("e.*")


def build(lines: DataFrame, start: str | None = None, end: str | None = None, articles: list[str] | None = None) -> dict:
    """The report.  Only aggregates come to the driver: one row, one per article, one per modality
    and at most ``NAMED_ERRORS`` errors."""
    entries = typed(lines)
    inside = compliance.scoped(entries, start, end)
    scoped = compliance.scoped(entries, start, end, articles)
    errors = audit_chain.verify_lines(lines)
    n_errors = errors.count()
    head = compliance.overview(scoped).first().asDict()
    per_article = [r.asDict() for r in compliance.per_article(scoped, articles).orderBy("article").collect()]
    leaks = inside.filter("pii_in_log").count()
    unlabeled = sum(a["content_generated"] - a["content_labeled"] for a in per_article if a["article"].endswith("50"))
    reasons = [r for r, bad in (("chain broken", n_errors), ("personal data in the log", leaks), ("synthetic content without label", unlabeled)) if bad]
    return {
        "period": {"from": start, "to": end},
        "overview": head,
        "articles": per_article,
        "modalities": [r.asDict() for r in compliance.content_modalities(scoped).orderBy("modality").collect()],
        "chain": {"valid": n_errors == 0, "n_errors": n_errors, "errors": [r.asDict() for r in errors.orderBy("file", "line_no").limit(NAMED_ERRORS).collect()]},
        "verdict": "NON_COMPLIANT" if reasons else "COMPLIANT",
        "reasons": reasons,
    }


def markdown(report: dict) -> str:
    o = report["overview"]
    out = [f"# Compliance report: {report['verdict']}", "", *(f"- {r}" for r in report["reasons"]), f"- entries: {o['entries']}, from {o['first_timestamp']} to {o['last_timestamp']}", f"- errors of the chain: {report['chain']['n_errors']}", ""]
    if report["articles"]:
        columns = list(report["articles"][0])
        out += ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        out += ["| " + " | ".join("" if a[c] is None else str(a[c]) for c in columns) + " |" for a in report["articles"]]
    return "\n".join(out) + "\n"


def write(report: dict, path: str) -> None:
    """As Markdown if the name ends in ``.md``, else as JSON."""
    text = markdown(report) if path.endswith(".md") else json.dumps(report, indent=2, ensure_ascii=False, default=str) + "\n"
    Path(path).write_text(text, encoding="utf-8")
