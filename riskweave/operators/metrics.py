"""Metrics of the shape of a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskweave.functions import paths
from riskweave.functions.dialect import translate
from riskweave.functions.scalars import half_up, indent_width, trim

# What counts as a decision.
DECISION_WORDS = r"\b(if|elif|for|foreach|while|case|when|catch|switch|and|or)\b|&&|\|\||\?\."
DECISION = translate(DECISION_WORDS)


def decisions(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DECISION)).cast("long")


def change_metrics(totals: DataFrame, files: DataFrame, lines: DataFrame, views: DataFrame) -> DataFrame:
    blank = trim(F.col("code")) == ""
    is_comment, is_code = blank & (trim(F.col("comment")) != ""), ~blank
    added = views.groupBy("diff_id").agg(
        F.sum(decisions(F.col("code"))).alias("decisions_added"), F.sum(is_comment.cast("long")).alias("comment_lines"), F.sum(is_code.cast("long")).alias("code_lines"),
        F.max(F.when(is_code, indent_width(F.col("raw")))).alias("widest"), F.min(F.when(is_code, indent_width(F.col("raw")))).alias("least"),
    )
    removed = lines.where("type = 'del'").groupBy("diff_id").agg(F.sum(decisions(F.col("text"))).alias("decisions_removed"))
    flagged = files.select("diff_id", *paths.flags(F.col("path")))
    kinds = flagged.groupBy("diff_id").agg(F.sum(F.col("is_test").cast("long")).alias("test_files"), F.sum((F.col("is_code") & ~F.col("is_test")).cast("long")).alias("code_files"))
    df = totals.join(added, "diff_id", "left").join(removed, "diff_id", "left").join(kinds, "diff_id", "left")
    zero = ["decisions_added", "decisions_removed", "comment_lines", "code_lines", "test_files", "code_files"]
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in zero}).withColumn("complexity_delta", F.col("decisions_added") - F.col("decisions_removed"))
    seen = F.col("comment_lines") + F.col("code_lines")
    ratio = F.when(seen > 0, half_up(F.col("comment_lines") / seen * 100) / 100).otherwise(0.0)
    minutes = F.greatest(F.lit(2), half_up(F.col("churn") / 8 + F.col("files") * 1.5 + F.greatest(F.lit(0), F.col("complexity_delta")) * 0.6))
    nesting = F.coalesce(F.greatest(F.lit(0), half_up((F.greatest(F.lit(0), F.col("widest")) - F.col("least")) / 4)), F.lit(0))
    return df.select(
        "diff_id", "files", "additions", "deletions", "churn", "complexity_delta", "decisions_added", "decisions_removed", nesting.cast("long").alias("max_nesting_added"),
        ratio.cast("double").alias("comment_ratio"), "comment_lines", "code_lines", "test_files", "code_files", minutes.cast("long").alias("review_minutes"),
    )


def language_mix(files: DataFrame) -> DataFrame:
    """languages: diff_id, language, churn, percent of the diff, and its place (churn descending, first seen first)."""
    by = files.groupBy("diff_id", "language").agg(F.sum("churn").cast("long").alias("churn"), F.min("file_idx").alias("first"))
    whole = F.sum("churn").over(W.partitionBy("diff_id"))
    place = F.row_number().over(W.partitionBy("diff_id").orderBy(F.desc("churn"), "first"))
    return by.select("diff_id", "language", "churn", F.when(whole > 0, half_up(F.col("churn") / whole * 100)).otherwise(0).cast("long").alias("percent"), place.alias("ord"))
