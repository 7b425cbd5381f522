"""Inline directives in comments that suppress rules on a line, the next line or a file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.dialect import translate

DEFAULT_PREFIX = "risk-"


def directive_pattern(prefix: str = DEFAULT_PREFIX, java: bool = True) -> str:
    return translate(re.escape(prefix).replace("\\-", "-") + r"(?:ignore|disable)(-next-line|-next|-line|-file)?\b[ \t]*:?[ \t]*([a-z0-9,\s_-]*)", ignore_case=True, java=java)


def parse_directive(comment: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    """struct<kind, rules> of the first directive, null without one. The prefix must occur in lower case."""
    pattern = directive_pattern(prefix)
    kind = F.lower(F.regexp_extract(comment, pattern, 1))
    named = F.when(kind == "-file", "file").when(kind.startswith("-next"), "next").otherwise("line")
    rules = F.filter(F.split(F.regexp_extract(comment, pattern, 2), translate(r"[,\s]+")), lambda s: (s != "") & (s != prefix.rstrip("-")))
    return F.when(comment.contains(prefix) & comment.rlike(pattern), F.struct(named.alias("kind"), rules.alias("rules")))


def suppressions(views: DataFrame, files: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """diff_id, path, scope (file or line), line (null for files), rule_id (null: all rules)."""
    found = views.where(F.col("comment").contains(prefix)).withColumn("d", parse_directive(F.col("comment"), prefix)).where("d is not null")
    found = found.join(files.select("diff_id", "file_idx", "path"), ["diff_id", "file_idx"])
    kind = F.col("d.kind")
    line = F.when(kind == "line", F.col("n")).when(kind == "next", F.col("n") + 1)
    return found.select("diff_id", "path", F.when(kind == "file", "file").otherwise("line").alias("scope"), line.alias("line"), F.explode_outer("d.rules").alias("rule_id"))


def mark_suppressed(hits: DataFrame, directives: DataFrame) -> DataFrame:
    """hits with `suppressed`: does a directive of its path cover its line and rule. A path's directives stay in one row."""
    by = directives.groupBy("diff_id", F.col("path").alias("s_path")).agg(F.collect_set(F.struct("line", "rule_id")).alias("directives"))
    joined = hits.join(by.withColumnRenamed("diff_id", "s_diff"), (F.col("diff_id") == F.col("s_diff")) & F.col("path").eqNullSafe(F.col("s_path")), "left")
    covers = F.exists("directives", lambda d: (d["line"].isNull() | (d["line"] == F.col("line"))) & (d["rule_id"].isNull() | (d["rule_id"] == F.col("rule_id"))))
    return joined.withColumn("suppressed", F.coalesce(covers, F.lit(False))).drop("s_diff", "s_path", "directives")
