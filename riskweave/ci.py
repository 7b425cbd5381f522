"""A run in continuous integration: find the diff, report it, write SARIF and step outputs, and enforce the gate last.

One analysis serves all outputs. The exit status is 1 if the gate fails, after everything has been written.
"""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
from pathlib import Path

from riskweave.functions.scalars import SEVERITIES
from riskweave.plans import config as configs
from riskweave.plans import export


def acquire(diff_file: str | None = None, base: str | None = None, folder: str = ".") -> str:
    """The diff of a checkout: a given file; else against the merge base with `base`, or `base` itself where there is none;
    else the last commit; else what isn't committed yet."""
    if diff_file:
        return Path(diff_file).read_text(encoding="utf-8")
    ways = [[f"{base}...HEAD"], [base, "HEAD"]] if base else [["HEAD~1", "HEAD"], ["HEAD"]]
    for way in ways:
        run = subprocess.run(["git", "-C", folder, "diff", *way], capture_output=True, text=True, encoding="utf-8", errors="replace", check=False)
        if run.returncode == 0:
            return run.stdout
    if base:
        raise ValueError(f"no diff against {base}: {run.stderr.strip()}")
    return ""


def main(argv: list[str] | None = None, stdout=None, spark=None) -> int:
    out = stdout or sys.stdout
    p = argparse.ArgumentParser(prog="riskweave-ci", description="Risk report of a checkout's change, with outputs for later steps.")
    p.add_argument("--base-ref", default="")
    p.add_argument("--diff-file", default="")
    p.add_argument("--folder", default=".")
    p.add_argument("--config", default="")
    p.add_argument("--fail-on", choices=["", *SEVERITIES], default="")
    p.add_argument("--max-score", type=int)
    p.add_argument("--sarif-file", default="riskweave.sarif")
    p.add_argument("--outputs", default=os.environ.get("GITHUB_OUTPUT", ""), help="file that takes name=value lines")
    args = p.parse_args(argv)
    text = acquire(args.diff_file, args.base_ref, args.folder)
    found = args.config or configs.find_up(args.folder)
    config = configs.load(found) if found else configs.normalize({})
    gate = dict(config.gate or {}) | ({"failOn": args.fail_on} if args.fail_on else {}) | ({"maxScore": args.max_score} if args.max_score is not None else {})
    from pyspark.sql import SparkSession

    from riskweave.plans.analyze import analyze
    from riskweave.sources.diffs import from_texts

    spark = spark or SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    report = analyze(from_texts(spark, {"change": text}), config)
    out.write(export.text_report(report).first()["report"] + "\n")
    Path(args.sarif_file).write_text(export.sarif(report).first()["report"], encoding="utf-8")
    score = report.scores.select("score", "tier").first()
    verdict = configs.evaluate_gate(report.scores, gate).first()
    outputs = {"sarif": args.sarif_file, "score": score["score"], "tier": score["tier"], "gate": "failed" if verdict["failed"] else "passed"}
    if args.outputs:
        with open(args.outputs, "a", encoding="utf-8") as f:
            f.writelines(f"{k}={v}\n" for k, v in outputs.items())
    out.write(f"Risk: {score['score']}/100 ({score['tier']}), gate {outputs['gate']}.\n")
    if verdict["failed"]:
        out.write(f"::error title=Gate failed::Risk {score['score']}/100 ({score['tier']}): {'; '.join(verdict['reasons'])}\n")
    return int(verdict["failed"])


if __name__ == "__main__":
    sys.exit(main())
