"""``python -m prismveil.cli scan TEXT | verify FOLDER | stats FOLDER | report FOLDER``."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="prismveil")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("scan").add_argument("text")
    for name in ("verify", "stats", "report"):
        sub.add_parser(name).add_argument("folder")
    sub.choices["report"].add_argument("--out")
    a = parser.parse_args(argv)
    if a.command == "scan":
        from prismveil.operators.detection import Engine

        for d in Engine().detect(a.text):
            print(f"{d.start}-{d.end} {d.category} ({d.source}, {d.confidence})")
        return 0
    from prismveil.operators import audit_chain, report
    from prismveil.sources import audit_log

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    lines = audit_log.read(spark, a.folder)
    if a.command == "verify":
        errors = audit_chain.verify_lines(lines).orderBy("file", "line_no")
        n = errors.count()
        for r in errors.limit(report.NAMED_ERRORS).collect():
            print(f"{r.file}:{r.line_no} seq={r.seq} -- {r.error}")
        print(f"{n} errors")
        return int(n > 0)
    if a.command == "stats":
        print(json.dumps(audit_chain.stats(report.typed(lines)).first().asDict(), default=str))
        return 0
    built = report.build(lines)
    if a.out:
        report.write(built, a.out)
    else:
        print(report.markdown(built))
    return int(built["verdict"] != "COMPLIANT")


if __name__ == "__main__":
    sys.exit(main())
