"""Command line: read a diff, print a report, exit 0 (passed), 1 (gate failed) or 2 (usage)."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from riskweave.functions.scalars import SEVERITIES
from riskweave.plans import config as configs
from riskweave.plans.export import FORMATS, coloured

VERSION = "1.0.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riskweave", description="Risk report of a unified diff.")
    p.add_argument("input", nargs="?", default="-", help="diff file, or - for standard input")
    p.add_argument("-f", "--format", default="text", choices=list(FORMATS))
    p.add_argument("-c", "--config")
    p.add_argument("--no-config", action="store_true")
    p.add_argument("--fail-on", choices=SEVERITIES)
    p.add_argument("--max-score", type=int)
    p.add_argument("-o", "--output")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--color", action=argparse.BooleanOptionalAction, help="colours in text reports; by default only on a terminal and without NO_COLOR")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    return p


def wants_colour(asked: bool | None, out) -> bool:
    if asked is False or os.environ.get("NO_COLOR"):
        return False
    return bool(asked) or bool(getattr(out, "isatty", lambda: False)())


def main(argv: list[str] | None = None, stdin=None, stdout=None, stderr=None, spark=None) -> int:
    out, err = stdout or sys.stdout, stderr or sys.stderr
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)

    def die(message: str) -> int:
        err.write(f"riskweave: {message}\n")
        return 2

    if args.max_score is not None and not 0 <= args.max_score <= 100:
        return die("--max-score must be a number 0-100")
    try:
        text = (stdin or sys.stdin).read() if args.input == "-" else Path(args.input).read_text(encoding="utf-8")
        found = None if args.no_config else args.config or configs.find_up(".")
        config = configs.load(found) if found else configs.normalize({})
    except (OSError, ValueError) as e:
        return die(str(e))
    if not text.strip():
        return die("no diff on standard input, and no file")
    gate = dict(config.gate or {}) | ({"failOn": args.fail_on} if args.fail_on else {}) | ({"maxScore": args.max_score} if args.max_score is not None else {})
    from pyspark.sql import SparkSession

    from riskweave.plans.analyze import analyze
    from riskweave.sources.diffs import from_texts

    spark = spark or SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    report = analyze(from_texts(spark, {"stdin": text}), config)
    rendered = FORMATS[args.format](report).first()["report"]
    verdict = configs.evaluate_gate(report.scores, gate).first()
    if args.output:
        Path(args.output).write_text(rendered, encoding="utf-8")
        if not args.quiet:
            err.write(f"riskweave: wrote {args.format} report to {args.output}\n")
    elif not args.quiet:
        if args.format == "text" and wants_colour(args.color, out):
            rendered = coloured(rendered)
        out.write(rendered if rendered.endswith("\n") else rendered + "\n")
    if gate:
        err.write("\nriskweave: GATE FAILED\n" + "".join(f"  - {r}\n" for r in verdict["reasons"]) if verdict["failed"] else "\nriskweave: gate passed\n")
    return int(verdict["failed"])


if __name__ == "__main__":
    sys.exit(main())
