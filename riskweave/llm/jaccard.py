"""N-gram Jaccard join under several global orders.

1. Each text's distinct shingles are counted over all texts. Blocks of documents first count their own, so a shingle
   reaches its task at most once a block. A shingle that no other text has can't be in an intersection, so a document
   whose unique shingles alone exceed what the threshold lets it lose links with nothing and is done.
2. Equal sets are one class, of which one document goes on.
3. The rest gets prefixes under three global orders: by frequency, by one hash and by another, with unique shingles first
   in each. Two sets over the threshold share a token in the prefixes of every order. Postings of the first order give
   candidates, the prefixes of the other orders must overlap too, and only then sets are fetched and verified.
4. Postings are joined in two rounds, so that a group of thousands of near copies isn't paired with itself: first each
   document with its posting's centre, the one with the fewest unique shingles; then only documents that share a posting
   but are still in different components, with all that share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.rolling import PrefixHash
from riskweave.llm.scratch import discard, materialize, parallelism
from riskweave.llm.textbytes import longs, mix64, utf8

#: Bytes of texts in a block, and slices of a partition that are counted one after the other.
UNIT = 1 << 21
PARTS = 8
MANY = np.uint16(65535)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_STEP = mix64(np.arange(1, 65))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct `width`-word shingles of each text, in order of row and hash; texts with fewer words have
    their whole sequence as one; A-Z count as a-z; words are runs of bytes other than space and \\x09-\\x0D."""
    n = len(offsets) - 1
    text = np.full(len(data) + n + 1, 32, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _FOLD[data]
    blank = _BLANK[text]
    begin = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    end = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    row = np.searchsorted(offsets[:-1] + np.arange(1, n + 1), begin, "right") - 1
    word = PrefixHash(text).spans(begin, end)
    first = np.searchsorted(row, np.arange(n))
    count = np.diff(np.r_[first, len(row)])
    m = len(word)
    full = np.zeros(m, np.uint64)
    for k in range(width):
        full[: m - k] += word[k:] * _STEP[k]
    whole = np.arange(m) + width <= (first + count)[row]
    rows, hashes = [row[whole]], [full[whole]]
    for i in np.flatnonzero((count > 0) & (count < width)):
        rows.append(np.array([i]))
        hashes.append(np.array([(word[first[i] : first[i] + count[i]] * _STEP[: count[i]]).sum(dtype=np.uint64) + np.uint64(count[i])], np.uint64))
    rows_, hashes_ = np.concatenate(rows), mix64(np.concatenate(hashes))
    order = np.lexsort((hashes_, rows_))
    rows_, hashes_ = rows_[order], hashes_[order]
    new = np.r_[True, (rows_[1:] != rows_[:-1]) | (hashes_[1:] != hashes_[:-1])] if len(rows_) else np.zeros(0, bool)
    return rows_[new], hashes_[new]


def units(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, rows, hashes) of blocks of whole documents, each of a bounded number of bytes or one document."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        ids = longs(batch.column(0))
        at = 0
        while at < len(ids):
            to = max(at + 1, min(int(np.searchsorted(offsets, offsets[at] + UNIT, "right")) - 1, at + 60000))
            rows, hashes = shingles(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], width)
            yield ids[at:to], rows, hashes
            at = to


def document_counts(docs: DataFrame, width: int) -> DataFrame:
    """id, n (distinct shingles), shared (of these, with another document; hash collisions may add some), d1, d2 (digest of the set)."""
    spark = docs.sparkSession
    parts = PARTS * parallelism(spark)
    names = ["part", "unit", "d", "i", "ids", "n", "digests", "mine"]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 6

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block is told apart by its task and number, as blocks can be alike in all rows.
        for unit, (ids, rows, hashes) in enumerate(units(batches, width), TaskContext.get().partitionId() << 32):
            size = np.bincount(rows, minlength=len(ids))
            edges = np.cumsum(np.r_[0, size])
            digests = b"".join(xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True))
            order = np.argsort(hashes)
            h, r = hashes[order], rows[order]
            new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            times = np.diff(np.r_[at, len(h)])
            mine = np.bincount(r[np.repeat(times > 1, times)], minlength=len(ids)) if len(h) else np.zeros(len(ids), int)
            tokens, owner = h[at], np.where(times > 1, MANY, r[at].astype(np.uint16))
            part = (tokens % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[by], np.arange(parts + 1))
            low = (tokens[by] >> np.uint64(24)).astype(np.uint32)
            rows_out = [(p, unit, low[a:b].tobytes(), owner[by][a:b].tobytes(), None, None, None, None) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            rows_out.append((unit % parts, unit, None, None, ids.tobytes(), size.astype(np.int64).tobytes(), digests, mine.astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows_out], t) for j, t in enumerate(kinds)], names=names)

    def counted(entries: list[tuple]) -> pa.RecordBatch:
        """Of one part, for each block the documents whose token another block has too, once for each such token."""
        d = np.frombuffer(b"".join([x[1] for x in entries]), np.uint32)
        i = np.frombuffer(b"".join([x[2] for x in entries]), np.uint16)
        order = np.argsort(d)
        ds = d[order]
        at = np.flatnonzero(np.r_[True, ds[1:] != ds[:-1]])
        times = np.diff(np.r_[at, len(ds)])
        found = np.sort(order[np.repeat(times > 1, times)])
        found = found[i[found] != MANY]
        cut = np.searchsorted(found, np.cumsum([0, *(len(x[2]) // 2 for x in entries)]))
        out = [(x[0], i[found[a:b]].tobytes()) for x, a, b in zip(entries, cut[:-1], cut[1:], strict=True) if b > a]
        none = pa.nulls(len(out), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), none, none, none, none], names=["unit", "i", "ids", "n", "digests", "mine"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of part, which is counted when it is complete."""
        held: list[tuple] = []
        part = None
        for batch in batches:
            through = batch.filter(pc.is_valid(batch.column("ids")))
            if through.num_rows:
                yield through.select(["unit", "i", "ids", "n", "digests", "mine"])
            for r in batch.filter(pc.is_null(batch.column("ids"))).to_pylist():
                if held and part != r["part"]:
                    yield counted(held)
                    held = []
                part = r["part"]
                held.append((r["unit"], r["d"], r["i"]))
        if held:
            yield counted(held)

    def gathered(rows: list[dict]) -> pa.RecordBatch:
        head = next(r for r in rows if r["ids"] is not None)
        ids, n = np.frombuffer(head["ids"], np.int64), np.frombuffer(head["n"], np.int64)
        total = np.frombuffer(head["mine"], np.int64).copy()
        for r in rows:
            if r["ids"] is None:
                total += np.bincount(np.frombuffer(r["i"], np.uint16), minlength=len(ids))
        digest = np.frombuffer(head["digests"], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, n, total, digest[:, 0].copy(), digest[:, 1].copy())], names=["id", "n", "shared", "d1", "d2"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and held[0]["unit"] != r["unit"]:
                    yield gathered(held)
                    held = []
                held.append(r)
        if held:
            yield gathered(held)

    blobs = docs.mapInArrow(split, "part int, unit long, d binary, i binary, ids binary, n binary, digests binary, mine binary")
    found = blobs.repartition(parallelism(spark), "part").sortWithinPartitions("part").mapInArrow(count, "unit long, i binary, ids binary, n binary, digests binary, mine binary")
    return found.repartition(parallelism(spark), "unit").sortWithinPartitions("unit").mapInArrow(gather, "id long, n long, shared long, d1 long, d2 long")


def components(links: DataFrame) -> DataFrame:
    """v, component (smallest vertex that links reach) for the vertices of links (a, b): labels move along links and then
    jump to their label's label, until none changes: labels only ever fall, so this ends. Each round is written to the
    shared scratch folder."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    written = labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("l")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy(F.col("a").alias("v")).agg(F.min("l").alias("near"))
        step = labels.join(near, "v").select("v", "l", F.least("l", "near").alias("m"))
        up = labels.select(F.col("v").alias("m"), F.col("l").alias("top"))
        step = step.join(up, "m", "left").select("v", "l", F.least("m", F.coalesce("top", "m")).alias("new"))
        done = materialize(step, "labels")
        discard(written)
        written, labels = done, done.select("v", F.col("new").alias("l"))
        if not done.where("l != new").limit(1).count():
            discard(both)
            return labels.select("v", F.col("l").alias("component"))


def needed(n: Column, percent: int) -> Column:
    """Least intersection that a set of n needs with any set: ceil(n * percent / 100)."""
    return F.ceil(n * percent / 100.0 - 1e-9)


def jaccard_links(docs: DataFrame, *, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row of docs.

    Two documents link if 100 * intersection >= percent * union of their sets of shingles; component_id is the smallest id
    that links reach. Texts without words, or null, have an empty set and link with nothing. Rows that repeat an id are one
    document, and a row each of the result, if they repeat its text. A row without id gets its count and no component. Shingles are compared by 64-bit
    hashes. Other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = materialize(document_counts(source, width), "jaccard_counts")
    no_id = int(np.iinfo(np.int64).min)
    real = (F.col("n") > 0) & (F.col("id") != no_id)
    classes = materialize(counts.where(real).groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), F.max("shared").alias("shared")), "jaccard_classes")
    chosen = materialize(classes.where(F.col("shared") >= needed(F.col("n"), percent)).select(F.col("rep").alias("id"), "n"), "jaccard_chosen")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, hashes in units(batches, width):
            edges = np.searchsorted(rows, np.arange(len(ids) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(hashes.view(np.int64)))], names=["id", "tokens"])

    # Spark broadcasts the chosen ids below its own size limit, else both sides are dealt by id.
    again = source.join(chosen.select("id"), "id", "left_semi").mapInArrow(tokens, "id long, tokens array<long>").dropDuplicates(["id"])
    sets = materialize(again, "jaccard_sets")
    flat = sets.select("id", F.explode("tokens").alias("token"))
    often = materialize(flat.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select(F.col("token").alias("t"), "df"), "jaccard_often")
    known = flat.join(often, F.col("token") == F.col("t")).groupBy("id").agg(F.collect_list(F.struct("df", "token")).alias("held"))
    known = known.join(chosen, "id").where(F.size("held") >= needed(F.col("n"), percent))
    # Unique shingles come first in every order; what is left of the prefix is taken from the others.
    room = (F.size("held") - needed(F.col("n"), percent) + 1).cast("int")
    by = lambda key: F.transform(F.slice(F.array_sort(F.transform("held", key)), F.lit(1), room), lambda x: x["token"])
    named = lambda *keys: lambda x: F.struct(*(k(x).alias(f"k{i}") for i, k in enumerate(keys)), x["token"].alias("token"))
    salted = lambda salt: lambda x: F.xxhash64(x["token"], F.lit(salt))
    # 256 parity bits of the shared shingles: two sets differ in at least as many shingles as their bits.
    bits = [F.expr(f"aggregate(filter(held, x -> pmod(xxhash64(x.token, 4), 4) = {w}), 0L, (a, x) -> a ^ shiftleft(1L, cast(pmod(xxhash64(x.token, 5), 64) as int)))").alias(f"b{w}") for w in range(4)]
    index = known.select(
        "id", "n", (F.col("n") - F.size("held")).alias("unique"), F.transform("held", lambda x: x["token"]).alias("tokens"),
        by(named(lambda x: x["df"], salted(1))).alias("p1"), by(named(salted(2))).alias("p2"), by(named(salted(3))).alias("p3"), *bits,
    )
    index = materialize(index, "jaccard_index")
    discard(sets, often, chosen)
    posting = materialize(index.select("id", "n", "unique", F.size("tokens").alias("held"), F.struct("b0", "b1", "b2", "b3").alias("bits"), F.explode("p1").alias("token")), "jaccard_postings")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda x, *names: index.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in names))
        both = pairs.join(side("a", "p2", "p3"), "a").join(side("b", "p2", "p3"), "b").where(F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b"))
        both = both.select("a", "b").join(side("a", "n", "tokens"), "a").join(side("b", "n", "tokens"), "b")
        inter = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return both.where(100 * inter >= percent * (F.col("n_a") + F.col("n_b") - inter)).select("a", "b")

    def possible(n1: str, n2: str, h1: str, h2: str, b1: str, b2: str) -> Column:
        """Sizes close enough, and shingles that differ no more than the needed intersection lets them: each side's unique
        ones and the bits that differ are a lower bound."""
        least = F.ceil((F.col(n1) + F.col(n2)) * percent / (100.0 + percent) - 1e-9)
        apart = F.col(n1) - F.col(h1) + F.col(n2) - F.col(h2)
        for w in range(4):
            apart = apart + F.bit_count(F.col(f"{b1}.b{w}").bitwiseXOR(F.col(f"{b2}.b{w}")))
        return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(h1, h2) >= least) & (apart <= F.col(n1) + F.col(n2) - 2 * least)

    rank = F.col("unique") * (1 << 32) + F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    centres = posting.groupBy(F.col("token").alias("t")).agg(F.min_by("id", rank).alias("centre"), F.min_by("n", rank).alias("cn"), F.min_by("held", rank).alias("ch"), F.min_by("bits", rank).alias("cb"), F.count("*").alias("m")).where("m > 1")
    centres = materialize(centres, "jaccard_centres")
    star = posting.join(centres, F.col("token") == F.col("t")).where((F.col("id") != F.col("centre")) & possible("n", "cn", "held", "ch", "bits", "cb"))
    pairs = materialize(star.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "jaccard_star")
    links = materialize(verified(pairs), "jaccard_links")
    label = components(links)
    labelled = materialize(posting.join(label, F.col("id") == F.col("v"), "left").select("id", "n", "held", "bits", "token", F.coalesce("component", "id").alias("component")), "jaccard_labelled")
    split = labelled.groupBy(F.col("token").alias("t")).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("t")
    split = materialize(split, "jaccard_split")
    rest = materialize(labelled.join(split, F.col("token") == F.col("t")).drop("t"), "jaccard_rest")
    left, right = (rest.select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "held", "bits", "token", "component"))) for x in "ab")
    cross = left.join(right, (F.col("token_a") == F.col("token_b")) & (F.col("component_a") < F.col("component_b")) & possible("n_a", "n_b", "held_a", "held_b", "bits_a", "bits_b"))
    cross = cross.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = materialize(verified(materialize(cross, "jaccard_cross")), "jaccard_more")
    label = materialize(components(links.unionByName(more)), "jaccard_components")
    discard(index, posting, centres, pairs, links, labelled, split, rest, more)
    named_class = classes.join(label, F.col("rep") == F.col("v"), "left").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("m"), F.coalesce("component", "rep").alias("component"))
    named_class = materialize(named_class, "jaccard_named")
    discard(classes, label)
    out = counts.join(named_class, real & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") == F.col("m")), "left")
    name = F.when(F.col("id") != no_id, F.col("id"))
    return out.select(name.alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id") != no_id, F.coalesce("component", "id")).alias("component_id"))
