"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere, and, as a report that removes
nothing, those covered by a shorter string of `passage` bytes that also starts in another document.

Anchors: of the 64-byte grams in each stretch of `passage` bytes, the one with the least hash. Equal strings of that size
have an anchor in common, at the same place in them, so only grams that are anchors twice or more matter, each with the
window of text from the first to the last string that it is the anchor of, each of these with `length` bytes. Equal windows around an anchor are one class, of which two
places, the first and the last, go on; of other windows each.

The windows of an anchor meet in a task. There each window is parsed into phrases, cut where the least of some neighbouring
grams begins, so that equal strings have the same phrases but for their ends. Shards of windows get a suffix array and a
Burrows-Wheeler transform of their own, over the alphabet of phrases. The transforms are merged by iterative interleave
refinement: the interleave says from which shard each suffix in the merged order comes; a pass reads each shard's transform
in its own order as the interleave calls for it, and deals the interleave stably by the symbols read, which makes it right
for one phrase more. Orders within a shard come from its transform alone and no suffix is sorted again. The pass in which
two neighbours part gives their common prefix, in phrases; intervals in which it reaches the phrases that a string of
either size has at least are repeated ones, and only strings in them are compared, by the hash of their whole bytes.

An anchor with more than `crowd` windows would be too much for a task: the strings of its windows are told apart by the
same hashes in an aggregation of the whole cluster, without a merge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.rolling import PrefixHash
from riskweave.llm.scratch import discard, materialize, parallelism
from riskweave.llm.substring import cut_runs, runs_of
from riskweave.llm.textbytes import longs, utf8

GRAM = 64
#: Bytes of the grams that cut phrases.
PHRASE_GRAM = 16
#: Positions whose anchors are chosen at once; bits that hold a position.
PLACE_BITS = 20
#: Bytes of windows merged at once, and of a shard of them.
MERGE = 1 << 20
SHARD = 1 << 18


def least_places(hashed: np.ndarray, w: int) -> np.ndarray:
    """For each stretch of w neighbours in hashed, the place of its least value (the last, in a tie, of the bits compared);
    ascending."""
    mask = np.uint64((1 << PLACE_BITS) - 1)
    step = (1 << PLACE_BITS) - w
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(hashed) - w + 1, step):
        part = hashed[at : at + step + w - 1]
        m = len(part)
        full = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        full[:m] = (part & ~mask) | (mask - np.arange(m, dtype=np.uint64))
        rows = full.reshape(-1, w)
        head = np.minimum.accumulate(rows, axis=1).ravel()
        tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(tail[: m - w + 1], head[w - 1 : m])
        found.append((mask - (least & mask)).astype(np.int64) + at)
    return np.concatenate(found)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first, last): the grams with the least hash of each stretch of `length` bytes, ascending, and the first and
    last begin of the stretches that a gram is the least of."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3
    least = least_places(PrefixHash(data).windows(GRAM), length - GRAM + 1)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[first], first, np.r_[first[1:], len(least)] - 1


def distinct(ascending: np.ndarray) -> np.ndarray:
    return ascending[np.r_[True, ascending[1:] != ascending[:-1]]] if len(ascending) else ascending


def phrase_width(length: int) -> int:
    """Grams of which the least cuts a phrase, where strings of `length` bytes are the shortest that matter."""
    return max(2, min(32, (length - PHRASE_GRAM) // 8))


def settled_phrases(length: int, w: int) -> int:
    """Phrases of a string of `length` bytes that its own bytes settle, at least: cuts w - 1 bytes or more from its begin and
    w + PHRASE_GRAM - 2 from its end, at most w apart."""
    return (length - PHRASE_GRAM - 2 * w + 3) // w - 1


def suffix_order(rank: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; rank: symbols, of which the terminators differ from each other and all else."""
    n, reach = len(rank), 1
    while True:
        key = rank.astype(np.int64) * (int(rank.max()) + 1) + rank[np.minimum(np.arange(n) + reach, n - 1)]
        order = np.argsort(key)
        new = np.r_[False, np.diff(key[order]) != 0]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new[1:].all():
            return order
        reach *= 2


class Shard:
    """Suffix array and Burrows-Wheeler transform of some strings; symbols: their phrases, each string ended by a zero."""

    def __init__(self, symbols: np.ndarray):
        ends = np.flatnonzero(symbols == 0)
        self.strings = len(ends)
        rank = symbols.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        self.order = suffix_order(rank)
        self.transform = symbols[self.order - 1]  # before a string's first phrase comes the zero that ends the one before it


def interleave(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(source, common): of each suffix in the merged order, its shard, and how many symbols, `depth` at most, it shares with
    the one before it. A shard's suffixes keep their order."""
    transform = np.concatenate([s.transform for s in shards])
    if transform.max(initial=0) < 1 << 16:
        transform = transform.astype(np.uint16)  # dealt by radix
    n, ends = len(transform), sum(s.strings for s in shards)
    kind = np.uint16 if len(shards) < 1 << 16 else np.int64
    source = np.repeat(np.arange(len(shards), dtype=kind), [len(s.order) for s in shards])
    terminators = np.repeat(np.arange(len(shards), dtype=kind), [s.strings for s in shards])
    common, block = np.full(n, depth), np.zeros(n, np.int64)
    symbol = np.empty(n, transform.dtype)
    for shared in range(depth):
        symbol[np.argsort(source, kind="stable")] = transform
        dealt = np.argsort(symbol, kind="stable")[ends:]
        parts = np.ones(n, bool)
        parts[ends + 1 :] = (np.diff(symbol[dealt].astype(np.int64)) != 0) | (np.diff(block[dealt]) != 0)
        common[parts] = np.minimum(common[parts], shared)
        block = np.cumsum(parts)
        source = np.r_[terminators, source[dealt]]
    return source, common


def merged(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the merged order, numbered through the shards; common)."""
    source, common = interleave(shards, depth)
    base = np.cumsum([0, *(len(s.order) for s in shards)])
    order = np.empty(len(source), np.int64)
    order[np.argsort(source, kind="stable")] = np.concatenate([s.order + b for s, b in zip(shards, base[:-1], strict=True)])
    return order, common


def repeated_starts(windows: list[bytes], begins: np.ndarray, owners: np.ndarray, length: int, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the joined windows at which a string starts that starts elsewhere too: strings of `length` bytes that do at
    another place, strings of `passage` bytes, no longer, that do in another document.

    begins, owners: place of each window's first byte in its document, and the document's number, so that windows that
    overlap in a document don't repeat each other.
    """
    w = phrase_width(passage)
    depths = settled_phrases(length, w), settled_phrases(passage, w)
    sizes = np.array([len(x) for x in windows], np.int64)
    end = np.cumsum(sizes)
    start = end - sizes
    data = np.frombuffer(b"".join(windows), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < passage:
        return none, none
    hashes = PrefixHash(data)
    window = np.repeat(np.arange(len(windows), dtype=np.int32), sizes)
    room = end[window] - np.arange(len(data))
    least = least_places(hashes.windows(PHRASE_GRAM), w)
    cuts = distinct(least[room[: len(least)] >= w - 1 + PHRASE_GRAM])
    inside = np.flatnonzero(window[cuts[1:]] == window[cuts[:-1]])  # phrases begin at these cuts and end at the next
    if not len(inside):
        return none, none
    begin = cuts[inside]
    symbol = np.unique(hashes.spans(begin, cuts[inside + 1]), return_inverse=True)[1] + 1
    mine = window[begin]
    ends = np.flatnonzero(np.r_[mine[1:] != mine[:-1], True]) + 1  # a string ends after these phrases
    symbols = np.insert(symbol, ends, 0)
    at = np.insert(begin, ends, -1)
    borders = np.r_[0, np.flatnonzero(np.diff(start[mine[ends - 1]] // SHARD)) + 1, len(ends)]
    edges = np.r_[0, ends + np.arange(1, len(ends) + 1)][borders]
    order, common = merged([Shard(symbols[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], max(depths))
    cut = at[order]
    number = owners.astype(np.int64) << PLACE_BITS + 20
    places = number + begins

    def found(size: int, depth: int, base: np.ndarray, moves: int) -> np.ndarray:
        """base: of each window, what tells places apart; moves: 1 if it counts bytes within the window, else 0."""
        first = np.flatnonzero(common < depth)
        place = np.where(cut >= 0, base[window[cut]] + moves * (cut - start[window[cut]]), -1)
        several = np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)
        live = np.sort(cut[np.repeat(several, np.diff(np.r_[first, len(order)]))])  # cuts in repeated intervals
        # A string's interval is that of its first cut w - 1 bytes or more from its begin.
        before = cuts[np.maximum(np.searchsorted(cuts, live) - 1, 0)]
        low = start[window[live]]
        low = np.where((before < live) & (before >= low), np.maximum(low, before - w + 2), low)
        high = np.minimum(live - w + 1, end[window[live]] - size)
        count = np.maximum(0, high - low + 1)
        starts = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        if not len(starts):
            return none
        whole = hashes.windows(size)[starts]
        by = np.argsort(whole)
        starts, whole = starts[by], whole[by]
        first = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]])
        place = base[window[starts]] + moves * (starts - start[window[starts]])
        several = np.minimum.reduceat(place, first) != np.maximum.reduceat(place, first)
        return starts[np.repeat(several, np.diff(np.r_[first, len(starts)]))]

    return found(length, depths[0], places, 1), found(passage, depths[1], number, 0)


def _find(length: int, passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "win", "id", "pos", "head", "size"]
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = longs(batch.column(0))
            for lo in range(0, len(ids), 500):
                out: dict[str, list] = {k: [] for k in names}
                for i in range(lo, min(lo + 500, len(ids))):
                    text = data[offsets[i] : offsets[i + 1]]
                    pos, begin, end = anchors(text, passage)
                    if not len(pos):
                        continue
                    raw = text.tobytes()
                    end = np.minimum(end + length, len(raw))
                    head = pos - begin
                    spans = list(zip(begin.tolist(), end.tolist(), pos.tolist(), strict=True))
                    out["anchor"].append(np.array([xxhash.xxh3_64_intdigest(raw[p : p + GRAM]) for _, _, p in spans], np.uint64))
                    out["win"].append(np.array([xxhash.xxh3_64_intdigest(raw[a:b], seed=p - a) for a, b, p in spans], np.uint64))
                    out["id"].append(np.full(len(pos), ids[i]))
                    out["pos"].append(pos)
                    out["head"].append(head)
                    out["size"].append(end - begin)
                if out["id"]:
                    kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)
                    joined = (np.concatenate(out[k]) for k in names)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(t)) for x, t in zip(joined, kinds, strict=True)], names=names)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "win", "id", "again", "begin", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            rows = []
            part = batch.slice(at, 200)
            flat = part.column("wins").flatten()
            wins = list(zip(*(flat.field(k).to_pylist() for k in ("anchor", "win", "again", "begin", "size")), strict=True))
            seen = 0
            for key, text, n in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), pc.list_value_length(part.column("wins")).to_pylist(), strict=True):
                raw = (text or "").encode()
                rows += [(anchor, win, key, again, begin, raw[begin : begin + size]) for anchor, win, again, begin, size in wins[seen : seen + n]]
                seen += n
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], t) for j, t in enumerate(kinds)], names=names)


def packed(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """int32 values as one binary entry for each of n rows; row ascends."""
    ends = np.cumsum(np.r_[0, np.bincount(row, minlength=n)]).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(values.astype(np.int32).tobytes())])


def unpacked(entries: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of values of each entry, values) of what packed made, without nulls."""
    ends = np.frombuffer(entries.buffers()[1], np.int32)[entries.offset : entries.offset + len(entries) + 1]
    if not len(entries) or ends[-1] == ends[0]:
        return np.zeros(len(entries), np.int64), np.zeros(0, np.int64)
    return np.diff(ends) // 4, np.frombuffer(entries.buffers()[2], np.int32, (ends[-1] - ends[0]) // 4, ends[0]).astype(np.int64)


def _merge(length: int, passage: int):
    def settle(rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        windows = [r[5] for r in rows]
        number = {d: i for i, d in enumerate(sorted({r[2:4] for r in rows}))}
        owners = np.array([number[r[2:4]] for r in rows], np.int64)
        borders = np.cumsum([0, *(len(w) for w in windows)])
        columns, some = [], np.zeros(n, bool)
        for starts, size in zip(repeated_starts(windows, np.array([r[4] for r in rows], np.int64), owners, length, passage), (length, passage), strict=True):
            starts = np.sort(starts)
            window = np.searchsorted(borders, starts, "right") - 1
            new = np.r_[True, (starts[1:] > starts[:-1] + size) | (window[1:] != window[:-1])] if len(starts) else np.zeros(0, bool)
            last = np.r_[np.flatnonzero(new)[1:], len(starts)] - 1 if len(starts) else np.zeros(0, int)
            window, a, b = window[new], starts[new], starts[last] + size
            columns += [packed(window, a - borders[window], n), packed(window, b - borders[window], n)]
            some[window] = True
        whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *columns], names=["anchor", "win", "a", "b", "c", "d"])
        return whole.filter(pa.array(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= MERGE and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield settle(held)

    return run


def _strings(length: int, passage: int):
    """The hash of each string of either size in each window, and where it starts in the window and in its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "win", "id", "again", "full", "h", "at", "place"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out: list[list[np.ndarray]] = [[] for _ in names]
                for anchor, win, doc, again, begin, text in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns), strict=True):
                    hashes = PrefixHash(np.frombuffer(text, np.uint8))
                    for size, full in ((length, True), (passage, False)):
                        h = hashes.windows(size).view(np.int64)
                        at = np.arange(len(h))
                        values = (anchor, win, doc, again, full)
                        for k, v in enumerate((*(np.full(len(h), x) for x in values), h, at.astype(np.int32), begin + at)):
                            out[k].append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)

    return run


def _marks(length: int, passage: int):
    """Runs of the strings of a window, from where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0), batch.column(1)]
            for size, lists in ((length, batch.column(2)), (passage, batch.column(3))):
                runs = [runs_of(x, x + size) for x in (np.sort(np.array(v, np.int64)) for v in lists.to_pylist())]
                columns += [pa.array([r[k].astype(np.int32).tobytes() for r in runs], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "win", "a", "b", "c", "d"])

    return run


MARKS = "anchor long, win long, a binary, b binary, c binary, d binary"


def crowded_marks(texts: DataFrame, length: int, passage: int) -> DataFrame:
    """What the merge gives, for windows of anchors with too many of them."""
    strings = materialize(texts.mapInArrow(_strings(length, passage), "anchor long, win long, id long, again boolean, full boolean, h long, at int, place long"), "suffix_strings")
    tells = F.struct("id", "again", F.when(F.col("full"), F.col("place")).otherwise(0))
    repeated = strings.groupBy(F.col("full").alias("full_"), F.col("h").alias("h_")).agg(F.min(tells).alias("lo"), F.max(tells).alias("hi")).where("lo != hi").select("full_", "h_")
    found = strings.join(materialize(repeated, "suffix_repeated").hint("merge"), (F.col("full") == F.col("full_")) & (F.col("h") == F.col("h_")))
    by = found.groupBy("anchor", "win").agg(F.collect_set(F.when(F.col("full"), F.col("at"))).alias("long"), F.collect_set(F.when(~F.col("full"), F.col("at"))).alias("short"))
    return by.mapInArrow(_marks(length, passage), MARKS)


def repeated_spans(docs: DataFrame, *, length: int, passage: int, crowd: int, id_col: str, text_col: str) -> DataFrame:
    """id, spans (array of base, a, b, c, d: int32 bytes): ranges of bytes to remove, and of shared passages."""
    spark = docs.sparkSession
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = materialize(source.mapInArrow(_find(length, passage), "anchor long, win long, id long, pos int, head int, size int"), "suffix_anchors")
    shared = materialize(found.groupBy(F.col("anchor").alias("anchor_")).agg(F.count("*").alias("n")).where("n > 1").select("anchor_"), "suffix_shared")
    live = materialize(found.join(shared, F.col("anchor") == F.col("anchor_")).drop("anchor_"), "suffix_live")
    discard(found, shared)
    place = F.struct("id", (F.col("pos") - F.col("head")).cast("long").alias("begin"), "size")
    classes = live.groupBy("anchor", "win").agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    classes = materialize(classes, "suffix_classes")
    crowds = classes.groupBy(F.col("anchor").alias("anchor_")).agg(F.sum(F.least("n", F.lit(2))).alias("m")).where(F.col("m") > crowd).select("anchor_")
    crowds = materialize(crowds, "suffix_crowds")
    # Rows that repeat an id are places of their own: `again` tells two that have all else in common.
    pair = F.array(F.struct("lo.*", F.lit(False).alias("again")), F.struct("hi.*", (F.col("lo") == F.col("hi")).alias("again")))

    def windows_of(some: DataFrame) -> DataFrame:
        wins = some.select("anchor", "win", F.explode(F.when(F.col("n") > 1, pair).otherwise(F.slice(pair, 1, 1))).alias("w"))
        wins = wins.groupBy(F.col("w.id").alias("id_")).agg(F.collect_list(F.struct("anchor", "win", "w.again", "w.begin", "w.size")).alias("wins"))
        # Rows that repeat an id repeat its text; one of them serves.
        return source.join(wins, F.col("id") == F.col("id_")).drop("id_").mapInArrow(_texts, "anchor long, win long, id long, again boolean, begin long, text binary")

    in_crowd = F.col("anchor") == F.col("anchor_")
    some_crowd = not crowds.isEmpty()
    texts = windows_of(classes.join(crowds, in_crowd, "left_anti") if some_crowd else classes)
    texts = texts.repartition(parallelism(spark), "anchor").sortWithinPartitions("anchor", "win")
    marks = texts.mapInArrow(_merge(length, passage), MARKS).dropDuplicates(["anchor", "win"])
    if some_crowd:
        marks = marks.unionByName(crowded_marks(windows_of(classes.join(crowds, in_crowd, "left_semi")), length, passage))
    marks = materialize(marks.select(F.col("anchor").alias("anchor_"), F.col("win").alias("win_"), "a", "b", "c", "d"), "suffix_marks")
    hit = live.join(marks, (F.col("anchor") == F.col("anchor_")) & (F.col("win") == F.col("win_")))
    return hit.groupBy("id").agg(F.collect_list(F.struct((F.col("pos") - F.col("head")).alias("base"), "a", "b", "c", "d")).alias("spans"))


def dedup(docs: DataFrame, *, length: int = 400, passage: int = 250, crowd: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 of the UTF-8 bytes that are left, joined, and n_shared.

    A byte goes if a string of `length` bytes covers it that also starts anywhere else, in the same text or another; all
    strings are judged on the input. n_shared counts the bytes, whether they go or stay, that a string of `passage` bytes
    (more than 64, and no more than `length`) covers which also starts in another document. Null and empty texts have no
    bytes. A row without id takes no part. Rows that repeat an id must repeat its text; each counts as a document of its
    own. Other columns are ignored; an empty table gives an empty one.
    """
    spans = repeated_spans(docs, length=length, passage=passage, crowd=crowd, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id_"), F.col(f"`{text_col}`").cast("string").alias("text"))
    joined = rows.join(spans, F.col("id_") == F.col("id"), "left").select("id_", "text", "spans")

    def spread(spans: pa.Array, begin: str, end: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, begin, end) of the union of each row's runs."""
        flat = spans.flatten()
        row = np.repeat(np.arange(len(spans)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy())
        base = flat.field("base").to_numpy()
        (count, a), (_, b) = unpacked(flat.field(begin)), unpacked(flat.field(end))
        at = (np.repeat(row, count) << 32) + np.repeat(base, count)  # rows far apart, so that one union serves them all
        a, b = runs_of(at + a, at + b)
        return a >> 32, a & 0xFFFFFFFF, b - (a & ~0xFFFFFFFF)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n = part.num_rows
                row, a, b = spread(part.column(2), "a", "b")
                cut = np.searchsorted(row, np.arange(n + 1))
                shared, c, d = spread(part.column(2), "c", "d")
                out = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    raw = (text or "").encode()
                    left, gone, runs = cut_runs(raw, a[cut[i] : cut[i + 1]], b[cut[i] : cut[i + 1]], whole_characters=False) if cut[i + 1] > cut[i] else (raw, 0, 0)
                    out.append((len(raw), gone, runs, hashlib.sha256(left).hexdigest()))
                columns = [pa.array([r[j] for r in out], t) for j, t in enumerate([pa.int64()] * 3 + [pa.string()])]
                columns = [part.column(0), *columns, pa.array(np.bincount(shared, (d - c).astype(float), n).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"])

    return joined.mapInArrow(apply, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long")
