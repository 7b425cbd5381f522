"""Cut lineage: parts that many others read are written once to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_FALLBACK: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the folder in spark.checkpoint.dir and return a reader. Where that is unset: a temporary folder if all runs
    in this process, else an error."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _FALLBACK:
            _FALLBACK.append(tempfile.mkdtemp(prefix="riskweave-"))
        root = _FALLBACK[0]
    path = f"{root.rstrip('/')}/riskweave/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
