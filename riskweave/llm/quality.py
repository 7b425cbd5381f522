"""Quality rules with host-level verdicts, in DataFrame functions only.

Each text gets base metrics, a base verdict and a failure or none of each rule. Failures are summed by host and rule; for
each rule a beta prior is fitted to all hosts by moments, which shrinks each host's rate; a host whose shrunk rate is, with
two posterior deviations to spare, several times the prior's mean for any rule loses all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.scratch import materialize

SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\f\r "
WINDOW = 8
#: Rules by name: a failure of a document, from its metrics. The last three are those of well-known public corpora.
RULES = {
    "base": "base_failed",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "lengths": "n_words > 0 and (word_chars < 3 * n_words or word_chars > 12 * n_words)",
}


def words(text: Column) -> Column:
    """The runs of characters other than space and \\x09-\\x0D."""
    return F.array_remove(F.split(F.translate(text, BLANKS[:-1], " " * 5), " "), "")


def base_metrics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of docs: id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    Null text: no words and zeros, so base_failed. Windows are compared by a 64-bit hash of their words' hashes.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").alias("host"), text.alias("t"))
    df = df.withColumn("w", words(F.col("t")))
    line = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = df.select(
        "id", "host", F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        line.alias("lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("wh"),
    )
    place = F.sequence(F.lit(1), F.size("wh") - (WINDOW - 1))
    df = df.withColumn("hashes", F.when(F.size("wh") >= WINDOW, F.transform(place, lambda i: F.xxhash64(F.slice("wh", i, WINDOW)))))
    df = df.select(
        "id", "host", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), F.col("hashes")).alias("hashes"),
    )
    sorted_pairs = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("pairs", sorted_pairs)
    twin = lambda p, j: (p["h"] == F.get("pairs", j - 1)["h"]) | (p["h"] == F.get("pairs", j + 1)["h"])
    df = df.withColumn("at", F.array_sort(F.transform(F.filter("pairs", lambda p, j: F.coalesce(twin(p, j), F.lit(False))), lambda p: p["i"])))
    step = F.transform("at", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1), x + WINDOW) - x))
    covered = F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    df = df.select("id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_verdicts(metrics: DataFrame, *, factor: float = 2.0, least: float = 0.2) -> DataFrame:
    """One row per host: n_docs, host_failed, and for each rule n_<rule> (failures), rate_<rule> (shrunk).

    The prior Beta(a, b) of a rule has the mean m of all documents and, beyond what sampling explains, the variance of the
    hosts' rates, each host counting by its documents; hosts that differ no more than sampling makes them shrink to m whole.
    A host fails a rule if its posterior's mean less two standard deviations is above `factor` times m and above `least`,
    below which a rule that hardly ever fails would condemn hosts most of whose documents are sound. Null is a host of its
    own.
    """
    hosts = metrics.groupBy("host").agg(F.count("*").alias("n_docs"), *(F.sum(F.expr(rule).cast("long")).alias(f"n_{name}") for name, rule in RULES.items()))
    n, all_docs = F.col("n_docs"), F.sum("n_docs")
    moments = [F.sum("n_docs").alias("n"), F.count("*").alias("hosts")]
    for name in RULES:
        f = F.col(f"n_{name}")
        moments += [(F.sum(f) / all_docs).alias(f"m_{name}"), (F.sum(f * f / n) / all_docs).alias(f"q_{name}")]
    moments = hosts.agg(*moments)
    prior = []
    for name in RULES:
        m = F.col(f"m_{name}")
        spread = m * (1 - m)
        between = F.col(f"q_{name}") - m * m - spread * F.col("hosts") / F.col("n")
        prior += [m, F.when(between > 0, F.greatest(spread / between - 1, F.lit(0.0))).alias(f"w_{name}")]
    out = hosts.join(F.broadcast(moments.select(*prior)))  # prior: one row
    failed = F.lit(False)
    for name in RULES:
        m, w = F.col(f"m_{name}"), F.col(f"w_{name}")
        rate = F.coalesce((F.col(f"n_{name}") + m * w) / (n + w), m)
        deviation = F.coalesce(F.sqrt(rate * (1 - rate) / (n + w + 1)), F.lit(0.0))
        out = out.withColumn(f"rate_{name}", rate)
        failed = failed | (rate - 2 * deviation > F.greatest(factor * m, F.lit(least)))
    return out.select("host", "n_docs", *(f"{k}_{name}" for name in RULES for k in ("n", "rate")), failed.alias("host_failed"))


def quality(docs: DataFrame, *, factor: float = 2.0, least: float = 0.2, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Base metrics of every document, base_failed, and kept: false if base_failed or if the host fails.

    Repeated rows count as documents of their own; other columns are ignored; an empty table gives an empty one.
    """
    metrics = materialize(base_metrics(docs, id_col=id_col, text_col=text_col, host_col=host_col), "quality_metrics")
    hosts = materialize(host_verdicts(metrics, factor=factor, least=least), "quality_hosts")
    failed = hosts.where("host_failed").select(F.col("host").alias("failed_host"), F.lit(True).alias("in_failed"))
    # Spark broadcasts the failing hosts below its own size limit and otherwise splits the skewed side of a merge join.
    out = metrics.join(failed, F.col("host").eqNullSafe(F.col("failed_host")), "left")
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("in_failed").isNull()).alias("kept"))
