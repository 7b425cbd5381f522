"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes cuts each text where the hash is small, so cuts follow content and insertions
shift nothing but their own chunk. Chunks are deduplicated by a 128-bit digest: the place with the smallest document id,
and in a document the first, owns a digest and stays. Neighbouring later chunks whose owners are neighbours too, on one
diagonal, form a segment; each segment is grown at both ends by the bytes, `reach` at each, that equal those around its
owner's place, as a repeated passage ends within a chunk. What is grown so occurs as a whole at the earlier place; it goes
if it has `min_run` bytes or `min_words` whole words.

Each task first dedupes its own block of documents, so that a digest reaches the task that owns it at most once a block,
however many documents hold it; what a block already knows to be repeated takes the same shuffle to any task, and then its
block's owner gives way to the first of all. Digests are settled in `PARTS` slices of a partition, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.scratch import discard, materialize, parallelism
from riskweave.llm.textbytes import longs, mix64, utf8

WINDOW = 16
#: Random value of each byte; zero for NUL, which pads texts.
GEAR = (mix64(np.arange(256)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
GEAR[0] = 0
#: Bytes of texts that a task dedupes together, and slices of a partition that are settled one after the other.
UNIT = 1 << 23
PARTS = 8


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j < WINDOW, by doubling the window."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    return h


def chunk_bounds(data: np.ndarray, offsets: np.ndarray, mean: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each chunk, start and end in data. A cut within `least` of the hash's cut before it is left
    out; gaps above `most` are cut at multiples of it."""
    sizes = np.diff(offsets)
    n = len(sizes)
    starts = offsets[:-1] + WINDOW * np.arange(1, n + 1)
    padded = np.zeros(int(sizes.sum()) + WINDOW * (n + 1), np.uint8)
    padded[np.arange(len(data)) + np.repeat(starts - offsets[:-1], sizes)] = data
    small = ((gear_hash(padded) >> np.uint32(10)) & np.uint32(0xFFFF)) < (1 << 16) // mean
    at = np.flatnonzero(small) + 1
    row = np.searchsorted(starts, at, "right") - 1
    inside = (row >= 0) & (at <= (starts + sizes)[np.maximum(row, 0)]) & (at > starts[np.maximum(row, 0)])
    at, row = at[inside] - starts[row[inside]] + offsets[row[inside]], row[inside]
    if len(at):
        close = np.r_[False, (np.diff(at) < least) & (row[1:] == row[:-1])]
        at = at[~close]
    cuts = np.unique(np.concatenate([at, offsets]))
    gap = np.diff(cuts)
    parts = np.maximum(1, -(-gap // most))
    first = np.repeat(cuts[:-1], parts)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first + nth * most
    end = np.minimum(begin + most, np.repeat(cuts[1:], parts))
    return np.searchsorted(offsets, begin, "right") - 1, begin, end


def later_ones(d1: np.ndarray, d2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, later, owner): entries by digest, document and start; for each in that order, whether an earlier place owns
    its digest, and the entry that does."""
    order = np.lexsort((start, doc, d2, d1))
    a, b, c, s = d1[order], d2[order], doc[order], start[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    owner = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0)) if len(a) else np.zeros(0, np.int64)
    return order, (c != c[owner]) | (s != s[owner]), order[owner]


def repeated_chunks(docs: DataFrame, *, id_col: str, text_col: str, mean: int, least: int, most: int) -> DataFrame:
    """id, starts, lens, owners, places: chunks of each document that repeat an earlier place, with the first of these, which
    is the same however docs is partitioned; int32 bytes, owners int64; several rows a document."""
    spark = docs.sparkSession
    parts = PARTS * parallelism(spark)
    kinds = {"doc": np.int64, "start": np.int32, "len": np.int32, "at": np.int32, "owner": np.int64, "place": np.int32}
    schema = "unit long, done boolean, doc binary, start binary, len binary, at binary, owner binary, place binary"
    names = [x.split()[0] for x in schema.split(", ")]
    raw = lambda rows, k: np.frombuffer(b"".join([r[k] for r in rows]), kinds[k])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = longs(batch.column(0))
            at, n = 0, len(ids)
            while at < n:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + UNIT, "right")) - 1)
                off = offsets[at : to + 1] - offsets[at]
                block = data[offsets[at] : offsets[to]]
                row, begin, end = chunk_bounds(block, off, mean, least, most)
                text = block.tobytes()
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)
                value = {"doc": ids[at:to][row], "start": (begin - off[row]).astype(np.int32), "len": (end - begin).astype(np.int32), "at": np.arange(len(row), dtype=np.int32)}
                order, later, owner = later_ones(digest[:, 0], digest[:, 1], value["doc"], value["start"])
                own, done, kept = order[~later], order[later], owner[later]
                part = (digest[own, 0] % np.uint64(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                own, part = own[by], part[by]
                edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
                rows = [(int(part[a]), unit, False, digest[own[a:b]].tobytes(), *(value[k][own[a:b]].tobytes() for k in ("doc", "start", "len", "at")), b"", b"") for a, b in zip(edges[:-1], edges[1:], strict=True)]
                for x, y in zip(*(np.array_split(z, max(1, len(done) // 20000)) for z in (done, kept)), strict=True):
                    local = (value["doc"][x], value["start"][x], value["len"][x], value["at"][y], value["doc"][y], value["start"][y])
                    rows += [(int(mix64(np.array([unit + len(rows)]))[0] % np.uint64(parts)), unit, True, b"", *(z.tobytes() for z in local))] if len(x) else []
                types = [pa.int32(), pa.int64(), pa.bool_()] + [pa.binary()] * 7
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=["part", "unit", "done", "d", *names[2:]])
                at, unit = to, unit + 1

    def settled(held: list[dict]) -> Iterator[pa.RecordBatch]:
        """Of one part, for each block the chunks that an earlier place owns."""
        d = np.frombuffer(b"".join([r["d"] for r in held]), "<u8").reshape(-1, 2)
        value = {k: raw(held, k) for k in ("doc", "start", "len", "at")}
        order, later, owner = later_ones(d[:, 0], d[:, 1], value["doc"], value["start"])
        found, kept = order[later], owner[later]
        back = np.argsort(found)
        found, kept = found[back], kept[back]
        value = {k: v[found] for k, v in value.items()} | {"owner": value["doc"][kept], "place": value["start"][kept]}
        cut = np.searchsorted(found, np.cumsum([0, *(len(r["at"]) // 4 for r in held)]))
        rows = [(r["unit"], a, b) for r, a, b in zip(held, cut[:-1], cut[1:], strict=True) if b > a]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([False] * len(rows), pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array([value[k][a:b].tobytes() for _, a, b in rows], pa.binary()) for k in names[2:]], names=names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of part, which is settled when it is complete; what a block knows passes through."""
        held: list[dict] = []
        for batch in batches:
            through = batch.filter(batch.column("done"))
            if through.num_rows:
                yield through.select(names)
            for r in batch.filter(pc.invert(batch.column("done"))).to_pylist():
                if held and held[0]["part"] != r["part"]:
                    yield from settled(held)
                    held = []
                held.append(r)
        if held:
            yield from settled(held)

    def resolved(held: list[dict]) -> Iterator[pa.RecordBatch]:
        """Of one block, chunks by document; owners within the block give way to the first place of all."""
        first, done = ({k: raw([r for r in held if r["done"] is x], k) for k in kinds} for x in (False, True))
        known = np.full(1 + max(first["at"].max(initial=-1), done["at"].max(initial=-1)), -1)
        known[first["at"]] = np.arange(len(first["at"]))
        to = known[done["at"]]
        owner, place = (np.where(to >= 0, np.r_[first[k], 0][to], done[k]) for k in ("owner", "place"))
        doc, start, size = (np.r_[first[k], done[k]] for k in ("doc", "start", "len"))
        owner, place = np.r_[first["owner"], owner], np.r_[first["place"], place].astype(np.int32)
        by = np.lexsort((start, doc))
        doc, start, size, owner, place = doc[by], start[by], size[by], owner[by], place[by]
        edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(1, int)
        for lo in range(0, len(edges) - 1, 5000):
            cut = list(zip(edges[lo : lo + 5000], edges[lo + 1 : lo + 5001], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(doc[[a for a, _ in cut]]), *(pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (start, size, owner, place))], names=["id", "starts", "lens", "owners", "places"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["unit"] != r["unit"]:
                    yield from resolved(held)
                    held = []
                held.append(r)
        if held:
            yield from resolved(held)

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blobs = source.mapInArrow(split, "part int, unit long, done boolean, d binary, doc binary, start binary, len binary, at binary, owner binary, place binary")
    known = blobs.repartition(parallelism(spark), "part").sortWithinPartitions("part").mapInArrow(settle, schema)
    return known.repartition(parallelism(spark), "unit").sortWithinPartitions("unit").mapInArrow(resolve, "id long, starts binary, lens binary, owners binary, places binary")


def _joined(spans: list[dict] | None, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(s[name], kind) for s in spans or []] or [np.zeros(0, kind)]).astype(np.int64)


def segments(start: np.ndarray, size: np.ndarray, owner: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(begin, end, owner, place) of maximal rows of chunks that repeat a row of chunks of one owner."""
    by = np.unique(start, return_index=True)[1]  # rows that repeat an id bring their chunks again
    start, size, owner, place = start[by], size[by], owner[by], place[by]
    new = np.r_[True, (start[1:] != (start + size)[:-1]) | (owner[1:] != owner[:-1]) | ((start - place)[1:] != (start - place)[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return list(zip(start[first].tolist(), (start + size)[last].tolist(), owner[first].tolist(), place[first].tolist(), strict=True))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both ends of each segment of a document: the segment, and the place beyond which its owner goes on."""
    for batch in batches:
        out = []
        for i, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            chunks = (_joined(spans, k, t) for k, t in (("starts", np.int32), ("lens", np.int32), ("owners", np.int64), ("places", np.int32)))
            for a, b, o, p in segments(*chunks):
                out.append((i, a, b, True, o, p + b - a))
                if a and p:
                    out.append((i, a, b, False, o, p))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], names=["id", "a", "b", "after", "owner", "place"])


def _surroundings(reach: int):
    """The bytes of a text before or after each place that is asked for, `reach` or fewer; rows come in order of id, and rows
    that repeat an id repeat its text: one of them serves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                out = []
                for i, text, asked in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns), strict=True):
                    if i == last:
                        continue
                    last = i
                    raw = (text or "").encode()
                    out += [(i, r["place"], r["after"], raw[r["place"] : r["place"] + reach] if r["after"] else raw[max(0, r["place"] - reach) : r["place"]]) for r in asked or []]
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], names=["owner_", "place_", "after_", "near"])

    return run


def segment_ends(texts: DataFrame, spans: DataFrame, *, reach: int) -> DataFrame:
    """id, ends (array of a, b, after, near): for each end of a segment, the bytes beyond its owner's place.

    texts has key and text; spans is a scratch table, which is removed. An end is asked for once a place, however many documents repeat it.
    """
    ends = materialize(spans.mapInArrow(_ends, "id long, a int, b int, after boolean, owner long, place int"), "substring_ends")
    discard(spans)
    asked = ends.groupBy("owner").agg(F.collect_set(F.struct("place", "after")).alias("asked"))
    near = texts.join(asked.hint("merge"), F.col("key") == F.col("owner")).select("key", "text", "asked").mapInArrow(_surroundings(reach), "owner_ long, place_ int, after_ boolean, near binary")
    # Without an aggregate on either side, so that Spark can split the copies of one passage among tasks.
    found = ends.join(near.hint("merge"), (F.col("owner") == F.col("owner_")) & (F.col("place") == F.col("place_")) & (F.col("after") == F.col("after_")))
    return found.groupBy("id").agg(F.collect_set(F.struct("a", "b", "after", "near")).alias("ends"))


def alike(x: bytes, y: bytes) -> int:
    """Length of the common head of two byte strings."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return int((np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)).argmax())


def grown(raw: bytes, ends: list[dict]) -> dict[tuple[int, int], list[int]]:
    """[begin, end] of each segment (a, b) after its ends moved over the bytes that equal those beyond the owner's place."""
    out: dict[tuple[int, int], list[int]] = {}
    for e in ends:
        at = out.setdefault((e["a"], e["b"]), [e["a"], e["b"]])
        near = e["near"]
        if e["after"]:
            at[1] = e["b"] + alike(raw[e["b"] : e["b"] + len(near)], near)
        else:
            at[0] = e["a"] - alike(raw[max(0, e["a"] - len(near)) : e["a"]][::-1], near[::-1])
    return out


def whole_words(raw: bytes, a: int, b: int) -> int:
    """Words of raw that lie whole in [a, b)."""
    blank = b" \t\n\x0b\x0c\r"
    part = raw[a:b]
    n = len(part.split())
    if n and a and part[0] not in blank and raw[a - 1] not in blank:
        n -= 1
    if n and b < len(raw) and part[-1] not in blank and raw[b] not in blank:
        n -= 1
    return n


def runs_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans as maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]


def cut_runs(raw: bytes, starts: np.ndarray, ends: np.ndarray, whole_characters: bool = True) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed). whole_characters: a run shrinks to character borders of the UTF-8."""
    left, at, removed, runs = [], 0, 0, 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        b = min(b, len(raw))
        if whole_characters:
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
        if b > a:
            left.append(raw[at:a])
            at, removed, runs = b, removed + b - a, runs + 1
    left.append(raw[at:])
    return b"".join(left), removed, runs


def dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mean: int = 32, least: int = 8, most: int = 128, reach: int = 384, min_run: int = 300, min_words: int = 50,
    keep_text: bool = False,
) -> DataFrame:
    """Every row of docs with its repeated runs removed: n_bytes, n_removed, n_spans, kept_sha256, and the row's other
    columns and the kept text if keep_text, else its id alone.

    The first place of a chunk is that with the smallest id, then the smallest offset. Null and empty texts have nothing to
    remove; a row without id is left as it is and owns nothing that has an id; rows that repeat an id must repeat the text,
    and keep it alike. Runs shrink to whole characters. Columns of docs named like the results are replaced; an empty table
    gives an empty one.
    """
    spans = repeated_chunks(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col=id_col, text_col=text_col, mean=mean, least=least, most=most)
    spans = materialize(spans.groupBy("id").agg(F.collect_list(F.struct("starts", "lens", "owners", "places")).alias("spans")), "substring_spans")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ends = segment_ends(texts, spans, reach=reach)
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kept = [c for c in docs.columns if c not in new] if keep_text else [id_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if not (keep_text and c == text_col)]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias("key"))
    joined = rows.join(ends.hint("merge"), F.col("key") == F.col("id"), "left").select("row", "text", "ends")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts, n_bytes, n_removed, n_spans, sha = [], [], [], [], []
                for text, ends_ in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    long = [x for x in grown(raw, ends_ or []).values() if x[1] - x[0] >= min_run or whole_words(raw, *x) >= min_words]
                    left, gone, runs = cut_runs(raw, *runs_of(np.array([x[0] for x in long], np.int64), np.array([x[1] for x in long], np.int64)))
                    texts.append(None if text is None else left.decode())
                    n_bytes.append(len(raw))
                    n_removed.append(gone)
                    n_spans.append(runs)
                    sha.append(hashlib.sha256(left).hexdigest())
                others = iter(part.column(0).flatten())
                columns = [pa.array(texts, pa.string()) if keep_text and c == text_col else next(others) for c in kept]
                columns += [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    schema = T.StructType([T.StructField(c, T.StringType()) if keep_text and c == text_col else docs.schema[c] for c in kept])
    for c, kind in zip(new, (T.LongType(), T.LongType(), T.LongType(), T.StringType()), strict=True):
        schema = schema.add(c, kind)
    return joined.mapInArrow(apply, schema)
