"""A corpus pipeline of five stages, each on all that its predecessor kept.

Toxic documents go; one document of each group of near duplicates stays; passages that repeat across documents are cut
but for their first place; sources are mixed to target weights; the mixture is encoded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, jaccard, mixing, substring, toxicity
from riskweave.llm.queries import held_out, vocabulary
from riskweave.llm.scratch import materialize, remove, scope, table


#: Columns of documents that stages read; others only pass through.
ROLES = ("doc_id", "text", "source", "n_chars")


def plain_names(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with columns that it doesn't read under names of their own, so that none clashes with its results."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in ROLES else f"column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*names), sf_dir).select(*names).toDF(*docs.columns)

    return run


@plain_names
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, trained on labelled rows that aren't held out, scores at its threshold or above.

    Null and empty texts have no word of either class and stay; repeated rows are judged alike; an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model).where("predicted = 0")


@plain_names
def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each component of five-word shingle sets of similarity 0.8 or more.

    Texts without words, null ones and rows without id stay; of rows that repeat an id all stay or go together.
    """
    found = jaccard.jaccard_links(docs, width=5, percent=80)
    gone = materialize(found.where("component_id != doc_id").select("doc_id").distinct(), "near_duplicates")
    return docs.join(gone, "doc_id", "left_anti")


@plain_names
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut runs of chunks that occur earlier; a document of which nothing but white space is left goes.

    Null and empty texts and rows without id stay as they are; n_chars, if there is one, becomes the length of what is left.
    """
    out = substring.dedup(docs, keep_text=True).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out


@plain_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources as documents; one that is taken again is a row again. Texts without words give nothing."""
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mixture, their number and the digests of ids and decoded text; none of an empty text."""
    return bpe.encode_documents(docs, vocabulary(), keep_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the stages; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope(spark):  # a stage's own tables and its input go when its result is written
            out = stage(spark, docs, sf_dir)
            docs = _written(out, f"stage_{name}")
        if before is not None:
            remove(spark, before)
        before = docs.scratch_path_
    return STAGES[-1][1](spark, docs, sf_dir)


def _written(df: DataFrame, name: str) -> DataFrame:
    with scope(df.sparkSession) as kept:
        out = materialize(df, name)
        kept.clear()
    return out
