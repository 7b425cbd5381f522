"""Sources of diffs: files, texts and streams of files; sinks of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.scalars import trim, utf16_length


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """One diff per file: diff_id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("diff_id"), F.col("value").alias("diff_text"))


def from_texts(spark: SparkSession, texts: dict) -> DataFrame:
    return spark.createDataFrame([(str(k), v) for k, v in texts.items()], "diff_id string, diff_text string")


def input_size(diffs: DataFrame) -> DataFrame:
    """diff_id, n_lines, n_chars (UTF-16 units) of each text; zeros for a blank one."""
    blank = F.length(trim(F.coalesce("diff_text", F.lit("")))) == 0
    lines, chars = F.size(F.split("diff_text", "\n", -1)), utf16_length(F.col("diff_text"))
    return diffs.select("diff_id", F.when(blank, 0).otherwise(lines).cast("long").alias("n_lines"), F.when(blank, 0).otherwise(chars).cast("long").alias("n_chars"))


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("diff_id"), F.col("value").alias("diff_text"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One row per diff, partition files of JSON lines (diff_id, report)."""
    reports.write.mode("overwrite").json(path)
