"""Exact top-k inner products over norm-sorted vectors.

Vectors are sorted by descending length and packed into chunks; queries into chunks of their own. Each query gets a first
k-th best score from the chunk with the longest vectors of its dimension. A chunk of queries then meets only the chunks
whose longest vector is long enough for one of its queries to reach that score: length times length bounds the product.
Within a chunk, vectors are taken in blocks by descending length: a query stops where length times length is below its k-th
best score, and within a block only vectors pass whose partial sum over the leading SVD-rotated dimensions plus the
Cauchy-Schwarz bound of the rest reaches it. What passes is scored exactly in integers. Queries are a stated subset and meet
all rows chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskweave.llm.scratch import discard, materialize, parallelism

CHUNK = 2048
BLOCK = 256
#: Vectors that the rotation is fitted on; the rotation decides how much is pruned, never what is found.
SAMPLE = 4096
#: Chunks of a dimension whose lengths every chunk of queries knows: evenly spread, so that it skips the shorter ones.
MARKS = 1024
LONGEST = (1 << 63) - 1


def length_of(x: np.ndarray) -> float:
    """Euclidean length, also where squares would overflow."""
    top = float(np.abs(x).max(initial=0))
    return top * float(np.sqrt(((x / top) ** 2).sum())) if top else 0.0


def near(x: int) -> float:
    """x as a double; infinite beyond its range."""
    try:
        return float(x)
    except OverflowError:
        return np.inf if x > 0 else -np.inf


def valid_vectors(df: DataFrame, *, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, norm, whole (little-endian doubles floor(scale * x), which are exact) of rows without null or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, norms, whole = [], [], [], []
            lists = batch.column(1)
            flat, offsets = lists.values, lists.offsets.to_numpy()
            usable = ~np.asarray(lists.is_null()) & ~np.asarray(batch.column(0).is_null())
            gaps = np.cumsum(np.r_[0, np.asarray(flat.is_null())])
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64))
            for i, key in enumerate(batch.column(0).to_pylist()):
                a, b = offsets[i], offsets[i + 1]
                if usable[i] and gaps[a] == gaps[b] and np.isfinite(values[a:b]).all():
                    ids.append(key)
                    dims.append(b - a)
                    norms.append(length_of(values[a:b]))
                    whole.append(values[a:b].astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(whole, pa.binary())], names=["id", "dim", "norm", "whole"])

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return source.mapInArrow(run, "id long, dim int, norm double, whole binary")


def pack(vectors: DataFrame, size: int, partitions: int) -> DataFrame:
    """Chunks of at most `size` vectors of one dimension, longest first: dim, top (largest norm), ids, whole; and their number c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            ids = np.array([r[0] for r in rows], "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([rows[0][1]], pa.int32()), pa.array([rows[0][2]]), pa.array([ids], pa.binary()), pa.array([b"".join(r[3] for r in rows)], pa.binary())], names=["dim", "top", "ids", "whole"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][1] != row[1] or len(held) == size):
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    ordered = vectors.repartitionByRange(partitions, "dim", F.desc("norm"), "id").sortWithinPartitions("dim", F.desc("norm"), "id")
    chunks = materialize(ordered.mapInArrow(run, "dim int, top double, ids binary, whole binary").withColumn("key", F.monotonically_increasing_id()), "topk_chunks")
    # One row a chunk, without its vectors.
    numbers = chunks.select(F.col("key").alias("key_"), (F.row_number().over(W.orderBy("dim", F.desc("top"), "key")) - 1).alias("c"))
    numbered = materialize(chunks.join(numbers.hint("merge"), F.col("key") == F.col("key_")).drop("key", "key_"), "topk_numbered")
    discard(chunks)
    return numbered


def search(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, v_ids: np.ndarray, v: np.ndarray, rotation: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query the (score, id) of its best k among v that are at least its floor, other than its own id, best first.

    q and v hold whole numbers; v is in order of descending length. Ties go to smaller ids. Scores are exact integers of any
    size. A bound that isn't a number prunes nothing.
    """
    d = q.shape[1]
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(d, 1) < 2.0**53
    lead = max(1, d // 4)
    q_norm, v_norm = (np.array([length_of(x) for x in m]) for m in (q, v))
    best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    floor = floor.copy()
    with np.errstate(over="ignore", invalid="ignore"):
        qr, vr = q @ rotation, v @ rotation
        q_rest, v_rest = np.sqrt((qr[:, lead:] ** 2).sum(1)), np.sqrt((vr[:, lead:] ** 2).sum(1))
        for at in range(0, len(v_ids), BLOCK):
            part = slice(at, at + BLOCK)
            reach = q_norm * v_norm[part].max()
            slack = 1e-6 * reach + 1e-3
            active = np.flatnonzero(~(reach + slack < floor))
            if not len(active):
                break
            bound = qr[active, :lead] @ vr[part, :lead].T + q_rest[active, None] * v_rest[None, part]
            hit = ~(bound + slack[active, None] < floor[active, None])
            hit &= q_ids[active, None] != v_ids[None, part]
            if not hit.any():
                continue
            cols = np.flatnonzero(hit.any(0))
            if exact:
                scores = (q[active] @ v[part][cols].T).astype(np.int64)
            else:
                wide = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(len(m), d)
                scores = wide(q[active]) @ wide(v[part][cols]).T
            ids = v_ids[part][cols]
            for row, a in enumerate(active):
                mine = np.flatnonzero(hit[row, cols])
                if exact and len(mine):
                    mine = mine[scores[row, mine] >= floor[a]]
                if len(mine):
                    found = best[a] + [(int(scores[row, c]), int(ids[c])) for c in mine]
                    found.sort(key=lambda x: (-x[0], x[1]))
                    best[a] = found[:k]
                    if len(best[a]) == k:
                        floor[a] = max(floor[a], near(best[a][-1][0]))
    return best


def fitted_rotation(x: np.ndarray) -> np.ndarray:
    """Right singular vectors of the directions of x."""
    top = np.abs(x).max(1, keepdims=True, initial=0)
    return np.linalg.svd(x / np.where(top > 0, top, 1.0), full_matrices=True)[2].T if x.shape[1] else np.zeros((0, 0))


def top_k(df: DataFrame, *, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best inner products with all other rows.

    Components become floor(scale * x). Vectors that are null, hold null or non-finite components, or one that scale makes
    infinite, or have a null id take no part; vectors of different lengths don't meet. Scores are compared exactly, however
    large; one beyond a long is returned as the nearest long. Rows that repeat an id are one candidate each, but never a
    candidate of a query with that id; a query with several rows is that with the first of its vectors in byte order. Ties
    go to the smaller id. Other columns are ignored; an empty table gives an empty one.
    """
    spark = df.sparkSession
    vectors = materialize(valid_vectors(df, scale=scale, id_col=id_col, vector_col=vector_col), "topk_vectors")
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("dim", "whole").collect()
    rotations = {d: fitted_rotation(np.array([np.frombuffer(r["whole"], "<f8") for r in sample if r["dim"] == d])) for d in {r["dim"] for r in sample}}
    shared = spark.sparkContext.broadcast(rotations)
    parts = parallelism(spark)
    chunks = pack(vectors, chunk, parts)
    first = vectors.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("whole", "dim", "norm")).alias("v")).select("id", "v.dim", "v.norm", "v.whole")
    queries = pack(first, 512, max(1, parts // 4))
    # One row for each dimension, with the lengths of MARKS of its chunks.
    heads = chunks.groupBy("dim").agg(F.min("c").alias("head"), F.max("c").alias("last"))
    step = F.ceil((F.col("last") - F.col("head") + 1) / MARKS)
    marks = chunks.select(F.col("dim").alias("dim_"), "c", "top").join(heads, F.col("dim_") == F.col("dim")).where((F.col("c") - F.col("head")) % step == 0)
    marks = marks.groupBy("dim").agg(F.first("head").alias("head"), F.first("last").alias("last"), F.array_sort(F.collect_list(F.struct("c", "top"))).alias("marks"))
    schema = "dim int, last int, head int, q_ids binary, q_whole binary, floors binary, query_id long, vec_id long, score binary"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                d = row["dim"]
                q_ids, v_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q, v = (np.frombuffer(row[c], "<f8").reshape(n, d) for c, n in (("q_whole", len(q_ids)), ("whole", len(v_ids))))
                seeding = row["floors"] is None
                floor = np.full(len(q_ids), -np.inf) if seeding else np.frombuffer(row["floors"], float)
                best = search(q_ids, q, floor, v_ids, v, shared.value.get(d, np.eye(d)), k)
                flat = [(int(i), vec, sortable(s)) for i, b in zip(q_ids, best, strict=True) for s, vec in b]
                cols = [[None] * len(flat)] * 6 + [[f[j] for f in flat] for j in range(3)]
                if seeding:
                    floors = np.array([near(b[-1][0]) if len(b) == k else -np.inf for b in best], float)
                    last = last_needed(np.array([length_of(x) for x in q]), floors, row["marks"], row["last"])
                    cols = [[d, *cols[0]], [last, *cols[1]], [row["head"], *cols[2]], [row["q_ids"], *cols[3]], [row["q_whole"], *cols[4]], [floors.tobytes(), *cols[5]], *([None, *c] for c in cols[6:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    asked = queries.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("whole").alias("q_whole")).join(marks, F.col("q_dim") == F.col("dim"))
    asked = asked.select("head", "last", "marks", "q_ids", "q_whole").withColumn("floors", F.lit(None).cast("binary"))
    seeded = materialize(asked.join(chunks.hint("merge"), F.col("head") == F.col("c")).drop("c", "top").mapInArrow(meet, schema), "topk_seeds")
    discard(vectors, queries)
    others = seeded.where("q_ids is not null").drop("dim", "query_id", "vec_id", "score").withColumn("want", F.explode(F.when(F.col("last") > F.col("head"), F.sequence(F.col("head") + 1, "last")).otherwise(F.array().cast("array<int>"))))
    met = others.repartition(parts, "want").join(chunks.hint("merge"), F.col("want") == F.col("c")).drop("c", "top", "want").mapInArrow(meet, schema)
    found = seeded.where("query_id is not null").unionByName(met).select("query_id", "vec_id", "score")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", as_long(F.col("score")).alias("score"))


def sortable(x: int) -> bytes:
    """Bytes in the order of integers: the number of bytes, biased by sign, then the number, of negative ones the complement."""
    size = max(8, (abs(x).bit_length() + 7) // 8)
    digits = (x if x >= 0 else x + (1 << 8 * size)).to_bytes(size, "big")
    return ((1 << 15) + size if x >= 0 else (1 << 15) - size).to_bytes(2, "big") + digits


def as_long(score: Column) -> Column:
    """The nearest long of a sortable score."""
    text = F.hex(score)
    digits = F.substring(text, 5, 16)
    # Sixteen digits of two's complement: the upper half is moved by hand, as conv knows unsigned numbers only.
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    positive = F.substring(text, 1, 4) >= "8000"
    fits = (F.length(text) == 20) & (positive == (high < 1 << 31))
    return F.when(fits, F.shiftleft(high, 32).bitwiseOR(low)).when(positive, F.lit(LONGEST)).otherwise(F.lit(-LONGEST - 1))


def last_needed(lengths: np.ndarray, floors: np.ndarray, marks: list[dict], last: int) -> int:
    """Number of the last chunk that a query could need: before the first mark whose longest vector is too short for all."""
    for mark in marks:
        with np.errstate(over="ignore", invalid="ignore"):
            reach = lengths * mark["top"]
            if (reach * (1 + 1e-6) + 1e-3 < floors).all():
                return mark["c"] - 1
    return last
