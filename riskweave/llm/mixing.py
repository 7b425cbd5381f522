"""Mixing sources to target weights, in DataFrame functions only.

The words of each source, its documents one after the other in a fixed pseudorandom order, are packed into blocks of
`block` words, the last of them shorter. The mixture is a sequence of slots, `shard` to an output shard; a source has as
many as blocks of its mean size make its target. All slots of all sources are dealt to the places of the sequence by one
pseudorandom permutation, so that the counts of sources in the shards are a multinomial draw, given that over all shards
each source comes to its number. Slot j of a source takes the block that the source's own pseudorandom permutation of its
block indexes gives for j modulo their number, another one in each round, so that no block is taken again before all have
been. Blocks and slots are joined by source and index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskweave.llm.quality import words
from riskweave.llm.scratch import discard, materialize, parallelism

REPEATS = 3
#: Rounds of a permutation: each moves about half of all numbers.
ROUNDS = 24
#: Documents of a source in a bucket, on average, and slots that are numbered in one row: what one task orders or makes at once.
BUCKET_DOCS = 250
WIDE = 1 << 13


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: s (its place by code point, null last), source, source_size, weight, target.

    Weights are 1, 2, 3, repeating. Targets share the sum of all sizes by weight; one above 3 times its source's size stops
    there, and the excess is shared again by weight: with sources in order of cap / weight, the stopped ones are the longest
    head of that order whose caps are at most what their weights would get.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("s", place).withColumn("weight", (F.col("s") % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(REPEATS))
    order = W.orderBy(F.col("cap") / F.col("weight"), "s")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    total = F.sum("source_size").over(everyone)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / weights).withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    first_free = F.min(F.when(~F.col("stops"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "s", "level"))).over(everyone)["level"]
    target = F.least(F.col("cap"), F.coalesce(first_free * F.col("weight"), F.col("cap")))
    return by.select("s", "source", "source_size", "n_docs", "weight", target.alias("target"))


def sums_before(rows: DataFrame, wide: str, at: str, value: str, name: str) -> DataFrame:
    """rows (s, wide, at, value) with column `name`: the sum of value over the rows of s that come before, by `at`.

    `wide` numbers ranges of `at`: ranges are summed first, then rows within a range, so that no task gets all rows of s.
    """
    heads = rows.groupBy(F.col("s").alias("s_"), F.col(wide).alias("wide_")).agg(F.sum(value).alias("n_"))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select("s_", "wide_", F.coalesce(F.sum("n_").over(earlier(W.partitionBy("s_").orderBy("wide_"))), F.lit(0)).alias("head_"))
    inside = F.coalesce(F.sum(value).over(earlier(W.partitionBy("s", wide).orderBy(at))), F.lit(0))
    rows = rows.withColumn("inside_", inside).join(heads.hint("merge"), (F.col("s") == F.col("s_")) & (F.col(wide) == F.col("wide_")))
    return rows.withColumn(name, F.col("head_") + F.col("inside_")).drop("s_", "wide_", "head_", "inside_")


def permuted(j: Column, m: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0 .. m - 1 that the key chooses puts j.

    Swap-or-not: in each round j and its mirror about the round's number change places or not, as a hash of the greater says.
    """

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.xxhash64(r, *key) % m - x, m)
        return F.when(F.xxhash64(F.greatest(x, mirror), r, *key, F.lit("side")) % 2 == 0, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), j.cast("long"), swap)


def slots(shares: DataFrame, *, shard: int, seed: int) -> DataFrame:
    """One row per slot: s, m, j, shard (which output shard the draw gives it to), block (which of the source's it takes).

    shares: s, m (blocks of the source), n (its slots); one row per source.
    """
    before = F.sum("n").over(W.orderBy("s")) - F.col("n")
    shares = shares.where("n > 0").withColumn("before", before).withColumn("all", F.sum("n").over(W.partitionBy()))
    # Numbers in two steps, so that no row holds an array of all of a source's.
    wide = shares.withColumn("wide", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / WIDE))))
    wide = wide.repartition(parallelism(shares.sparkSession), "s", "wide")  # few small rows, of which each makes WIDE slots
    each = wide.withColumn("j", F.explode(F.sequence(F.col("wide") * WIDE, F.least(F.col("wide") * WIDE + (WIDE - 1), F.col("n") - 1))))
    place = permuted(F.col("before") + F.col("j"), F.col("all"), F.lit(seed), F.lit("place"))
    taken = permuted(F.col("j") % F.col("m"), F.col("m"), F.col("s"), F.floor(F.col("j") / F.col("m")), F.lit(seed))
    return each.select("s", "m", "j", F.floor(place / shard).alias("shard"), taken.alias("block"))


def mix_plan(docs: DataFrame, *, block: int = 64, shard: int = 256, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): documents has one row per row of docs: row id, id, size, source_size, target, taken, and source
    and content (the text's hash), which with the id tell what row of docs it is;
    pieces has the word ranges that the mixture takes: rid, from_word, n_words, times.

    A source comes within half a block of its target, however small. A block is taken at most 3 times, so no document gives
    more than 3 times its words. Null texts have size 0 and give
    nothing. Rows are told apart by their content, so exact repeats share their order's ties, which changes no total.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words(text)).cast("long").alias("size"), F.xxhash64(text).alias("content"))
    sized = materialize(sized, "mix_sizes")
    targets = materialize(source_targets(sized).coalesce(1), "mix_targets")
    # Places of words within a source: sums over buckets of documents, then within a bucket, so that no task gets a source.
    buckets = F.ceil(F.col("n_docs") / float(BUCKET_DOCS))
    # Null adds nothing to a hash: only rows without id are dealt by their content.
    nameless = F.when(F.col("id").isNull(), F.col("content"))
    bucket = F.pmod(F.xxhash64("id", nameless, F.lit(seed)), buckets)
    wide = F.floor(bucket / F.ceil(F.sqrt(buckets)))
    docs_in = sized.join(targets.select("s", F.col("source").alias("src"), "source_size", "n_docs", "target"), F.col("source").eqNullSafe(F.col("src"))).select("id", "s", "source", "content", "size", "source_size", "target", bucket.alias("bucket"), wide.alias("wide"))
    bucket_sums = materialize(docs_in.groupBy("s", "wide", "bucket").agg(F.sum("size").alias("n")), "mix_sums")
    sums = materialize(sums_before(bucket_sums, "wide", "bucket", "n", "offset").select(F.col("s").alias("s_"), F.col("bucket").alias("bucket_"), "offset"), "mix_offsets")
    inside = W.partitionBy("s", "bucket").orderBy(F.xxhash64("id", nameless, F.lit(seed + 1)), "id", "size", "content")
    placed = docs_in.withColumn("in_bucket", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(sums, (F.col("s") == F.col("s_")) & (F.col("bucket") == F.col("bucket_")))
    placed = materialize(placed.select(F.monotonically_increasing_id().alias("rid"), "id", "s", "source", "content", "size", "source_size", "target", (F.col("offset") + F.col("in_bucket")).alias("start")), "mix_placed")
    # Slots of a source: as its last block is short, its target counts in blocks of mean size; at 3 times its size, 3 rounds.
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    wanted = F.least(REPEATS * F.col("m"), F.round(F.col("target") * F.col("m") / F.col("source_size")).cast("long"))
    shares = targets.where("source_size > 0").withColumn("m", blocks).select("s", "m", wanted.alias("n")).coalesce(1)
    drawn = materialize(slots(shares, shard=shard, seed=seed), "mix_slots")
    taken_blocks = drawn.groupBy("s", "block").agg(F.count("*").alias("times"))
    parts = placed.where("size > 0").select("rid", "s", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    # Estimates of exploded rows are far too low: without the hint all blocks would be broadcast.
    joined = parts.join(taken_blocks.hint("merge"), ["s", "block"])
    lo = F.greatest(F.col("block") * block, F.col("start"))
    hi = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    pieces = joined.select("rid", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("n_words"), "times")
    pieces = materialize(pieces, "mix_pieces")
    discard(sized, bucket_sums, sums, drawn)
    taken = pieces.groupBy(F.col("rid").alias("rid_")).agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
    documents = placed.join(taken, F.col("rid") == F.col("rid_"), "left").select("rid", F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("source").alias("mix_source"), "content")
    return documents, pieces


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken (words, repeats counted)."""
    return mix_plan(docs, **options)[0].drop("rid", "mix_source", "content")


def mixed_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture as documents: for each document and each time r = 1, 2, 3, a row with the words of its blocks that are
    taken at least r times, in order and with the white space that follows them; none if there are no such blocks.

    n_chars, if docs has it, is set to the new length; other columns are repeated. Each row gets its own pieces, without id
    too: rows go by id, source and text, and of rows that are alike in these the n-th gets those of the n-th in the plan.
    """
    documents, pieces = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    by = pieces.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("from_word", "n_words", "times"))).alias("pieces"))
    by = documents.select("rid", F.col(id_col).alias("mix_id"), "mix_source", "content").join(by, "rid", "left")
    # Rows that are alike would multiply in the join: one list for them all, with a null for each that gives nothing.
    by = by.groupBy("mix_id", "mix_source", "content").agg(F.sort_array(F.collect_list(F.struct("rid", "pieces")))["pieces"].alias("lists"), F.count("pieces").alias("some")).where("some > 0")
    text = F.col(text_col).cast("string")
    tokens = F.regexp_extract_all(F.col("text"), F.lit(r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("row_id"), F.col(source_col).alias("row_source"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row_content"), text.alias("text"))
    alike = W.partitionBy("row_id", "row_source", "row_content").orderBy("row_id")
    rows = rows.withColumn("nth", F.row_number().over(alike))
    same = F.col("row_id").eqNullSafe(F.col("mix_id")) & F.col("row_source").eqNullSafe(F.col("mix_source")) & (F.col("row_content") == F.col("content"))
    out = rows.join(by.hint("merge"), same).select("row", tokens.alias("tokens"), F.get("lists", F.col("nth") - 1).alias("pieces")).where("pieces is not null")
    out = out.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    out = out.withColumn("chosen", F.filter("pieces", lambda p: p["times"] >= F.col("r"))).where(F.size("chosen") > 0)
    text = F.array_join(F.flatten(F.transform("chosen", lambda p: F.slice(F.col("tokens"), (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")))), "")
    out = out.select("row", text.alias("mixed"))
    new = {text_col: F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
