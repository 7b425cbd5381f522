"""Shared scratch tables: cut lineage with written Parquet in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []
_SCOPES: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where that is unset: a temporary folder if all runs in this process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="riskweave-"))
    return _FALLBACK[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/riskweave/{uuid.uuid4().hex}/{name}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and return a reader of it: later reads survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path_ = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path_)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end what was written to the scratch folder in it, but what was taken off its list."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


#: Rows of a batch that goes to a Python worker: whole texts, so that far fewer than Spark's 10,000 are enough.
BATCH_ROWS = 1000
#: Allocator settings of Python workers, which live on between stages: large arrays go back to the system when freed.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "16777216", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. Python workers get this library's folder on their path, wherever the driver was started, memory
    settings, and batches of at most BATCH_ROWS rows, or fewer if the session says so."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, min(BATCH_ROWS, int(spark.conf.get(batch)) if int(spark.conf.get(batch)) > 0 else BATCH_ROWS))
    for name_, value in {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), **WORKER_MEMORY}.items():
        spark.sparkContext.environment.setdefault(name_, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
