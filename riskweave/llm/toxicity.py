"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled rows (`max_train`, the smallest hashes of their ids), counts in how many toxic
and clean texts each n-gram occurs, and fits an L2-regularized logistic regression on the presence of all n-grams, each
scaled by its log-count ratio and each text to length one. N-grams are those of lower-cased characters, whatever their script, hashed into 2 ** BITS
buckets; no bucket is left out. What reaches the driver is bounded by `max_train` texts. Scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.scratch import materialize
from riskweave.llm.textbytes import longs

#: Characters of an n-gram, and bits of the bucket number.
ORDER = 5
BITS = 18
#: Texts without a decision that every n-gram has beforehand, in proportion to the classes: rare n-grams keep ratios near zero.
PRIOR = 40.0
#: Characters hashed at once: one very long text is hashed in parts.
BLOCK = 1 << 18


def ngram_buckets(text: str) -> np.ndarray:
    """Bucket of the n-gram that starts at each character of the lower-cased text, with a space before and after it."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    n = max(0, len(code) - ORDER + 1)
    out = np.empty(n, np.uint32)
    for at in range(0, n, BLOCK):
        part = code[at : at + BLOCK + ORDER - 1].astype(np.uint64)
        m = len(part) - ORDER + 1
        mixed = np.zeros(m, np.uint64)
        for i in range(ORDER):
            mixed = (mixed + part[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        out[at : at + m] = mixed >> np.uint64(64 - BITS)
    return out


class Present:
    """The distinct buckets of texts, without sorting: the last n-gram of each bucket counts."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        found = ngram_buckets(text or "")
        at = np.arange(len(found))
        self.last[found] = at
        return found[self.last[found] == at]


@dataclass(frozen=True)
class ToxicityModel:
    """weights: of each n-gram bucket, ratio times fitted weight; bias; scale: the ratios, which give a text its length."""

    weights: np.ndarray
    bias: float
    scale: np.ndarray | None = None

    def score(self, texts: list[str | None], present: Present | None = None) -> np.ndarray:
        present = present or Present()
        total = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            found = present(text)
            size = 1.0 if self.scale is None else float(np.square(self.scale[found]).sum()) ** 0.5
            total[i] += self.weights[found].sum() / (size or 1.0)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def log_count_ratios(seen: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Of each bucket, from the number of clean and toxic texts that hold it."""
    n = n0 + n1
    return np.log((seen[1] + PRIOR * n1 / n) / n1) - np.log((seen[0] + PRIOR * n0 / n) / n0)


def fit_logistic(columns: list[np.ndarray], scale: np.ndarray, y: np.ndarray, *, l2: float, rate: float = 0.5, epochs: int = 15, size: int = 64) -> tuple[np.ndarray, float]:
    """Weights and bias, by adaptive steps over small groups of rows in a fixed order; columns: of each row, those that are one."""
    n, k = len(columns), len(scale)
    w, bias, seen, seen_bias = np.zeros(k), 0.0, np.full(k, 1e-8), 1e-8
    order = np.random.default_rng(7).permutation(n)
    for _ in range(epochs):
        for at in range(0, n, size):
            rows = order[at : at + size]
            cols = np.concatenate([columns[r] for r in rows])
            row = np.repeat(np.arange(len(rows)), [len(columns[r]) for r in rows])
            value = scale[cols]
            length = np.sqrt(np.bincount(row, value * value, len(rows)))
            value /= np.where(length > 0, length, 1.0)[row]
            error = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[cols], len(rows)) + bias, -30, 30))) - y[rows]
            g = np.bincount(cols, value * error[row], k) / len(rows) + l2 * w
            seen += g * g
            w -= rate * g / np.sqrt(seen)
            g_bias = float(error.mean())
            seen_bias += g_bias * g_bias
            bias -= rate * g_bias / seen_bias**0.5
    return w, bias


def train(texts: DataFrame, labels: DataFrame, *, max_train: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on the labelled rows of `labels` (id, 0 or 1) whose text is in `texts`, at most max_train of them.

    Null ids, labels other than 0 and 1 and ids whose labels contradict each other are left out; of rows that repeat an id
    the first text in order counts, once. Other columns don't matter, whatever their names. Without rows of both classes
    every score is the share of ones.
    """
    sample = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
        .groupBy("id").agg(F.max("y").alias("y"), F.min("y").alias("least")).where("y = least").select("id", "y").orderBy(F.xxhash64("id"), "id").limit(max_train)
    )
    picked = F.broadcast(sample)  # at most max_train rows of two numbers
    rows = texts.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(picked, "id")
    rows = materialize(rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")), "toxicity_train")
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return ToxicityModel(np.zeros(1 << BITS), -30.0 if not n1 else 30.0)

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Present()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = [present(x).astype(np.int32).tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(cols, pa.binary())], names=["id", "y", "cols"])

    ones = rows.select("id", "text", "y").mapInArrow(design, "id long, y int, cols binary").toArrow().sort_by("id")  # at most max_train rows
    cols = [np.frombuffer(x.as_buffer(), np.int32) for x in ones.column("cols")]
    y = longs(ones.column("y"))
    seen = np.zeros((2, 1 << BITS), np.int64)
    for x, c in zip(cols, y, strict=True):
        seen[c][x] += 1
    scale = log_count_ratios(seen, n0, n1)
    w, bias = fit_logistic(cols, scale, y.astype(float), l2=0.3 / len(y))
    return ToxicityModel(scale * w, float(bias), scale)


def score(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with score (0 to 1, higher: likelier toxic) and predicted (1 if score >= threshold, else 0).

    Null and empty texts get the score of a text without words. All rows are kept, repeated ones too, and all columns or
    those of `keep`, as they are; columns named score or predicted are replaced. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers
    kept = [c for c in keep or docs.columns if c not in ("score", "predicted")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    at_text = kept.index(text_col) if text_col in kept and dict(docs.dtypes)[text_col] == "string" else None
    source = docs.select(row) if at_text is not None else docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Present()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns = part.column(0).flatten()
                s = shared.value.score((part.column(1) if at_text is None else columns[at_text]).to_pylist(), present)
                columns += [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "score", "predicted"])

    schema = T.StructType([docs.schema[c] for c in kept]).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return source.mapInArrow(run, schema)
