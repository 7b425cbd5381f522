"""Analyse a stream of diffs: one row is a whole change, so each micro-batch is analysed by itself, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskweave.plans.analyze import analyze
from riskweave.plans.config import Config


def score_stream(diffs: DataFrame, path: str, checkpoint: str, config: Config | None = None):
    """A query that appends diff_id, score, tier and summary of each new diff to Parquet under path; a batch that is run
    again replaces its own files."""

    def write(batch: DataFrame, epoch: int) -> None:
        report = analyze(batch, config)
        report.scores.select("diff_id", "score", "tier", "summary").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return diffs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
