"""The rule catalog: order, lookups and the table of all rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.functions.catalog_values import FILE_RULES, LINE_RULES

RULES = [*LINE_RULES, *FILE_RULES]
BY_ID = {r["id"]: r for r in RULES}
#: Order in which signals are produced: line rules, executable file rules, the entropy rule, the aggregate.
SEQUENCE = [r["id"] for r in LINE_RULES] + [r["id"] for r in FILE_RULES if r["id"] not in ("logic-without-tests", "entropy-secret")] + ["entropy-secret", "logic-without-tests"]
SCHEMA = "rule_id string, seq int, title string, category string, severity string, base_severity string, confidence double, cwe string, owasp string, why string, fix string"


def rule_table(spark: SparkSession, severity: dict[str, str] | None = None) -> DataFrame:
    """One row per rule, with overridden severities."""
    over = severity or {}
    rows = [(r["id"], SEQUENCE.index(r["id"]), r["title"], r["category"], over.get(r["id"], r["severity"]), r["severity"], float(r["confidence"]), r["cwe"], r["owasp"], r["why"], r["fix"]) for r in RULES]
    return spark.createDataFrame(rows, SCHEMA)
