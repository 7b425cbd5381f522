"""Line rules, file rules, the entropy rule and the aggregate rule: candidates, suppression and caps."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskweave.functions import paths
from riskweave.functions.catalog import BY_ID, SEQUENCE
from riskweave.functions.catalog_values import LINE_RULES
from riskweave.functions.dialect import needed_literals, translate
from riskweave.functions.scalars import number, trim, truncate, utf16_length
from riskweave.operators.entropy import best_finding
from riskweave.plans.config import Config

#: Columns of hits; order: file_idx, then added_idx.
HIT = ["diff_id", "rule_id", "seq", "file_idx", "added_idx", "path", "line", "snippet", "detail"]


def _fires(rule: dict) -> Column:
    view = {"raw": "raw", "code": "code", "string": "strings_view", "comment": "comment"}[rule["view"]]
    if rule["id"] == "long-line":  # counted in UTF-16 units
        cond = (F.length("raw") >= 250) & (utf16_length(F.col("raw")) >= 500) & ~F.col("raw").rlike(r"[\n\r\x{2028}\x{2029}]")
    else:
        cond = F.col(view).rlike(translate(rule["pattern"], rule["ignore_case"]))
        literals = needed_literals(rule["pattern"], rule["ignore_case"])
        if literals:  # a search for plain texts costs a small part of the pattern's
            cond = reduce(or_, [F.col(f"low_{view}" if rule["ignore_case"] else view).contains(x) for x in literals]) & cond
    cond = (F.col(view) != "") & cond
    return F.col(rule["files"]) & cond if rule["files"] else cond


def _scanned(views: DataFrame, files: DataFrame) -> DataFrame:
    live = files.where(~F.col("is_binary") & (F.col("status") != "deleted")).select("diff_id", "file_idx", "path", *paths.flags(F.col("path")))
    return views.join(live, ["diff_id", "file_idx"])


def line_candidates(views: DataFrame, files: DataFrame, config: Config) -> DataFrame:
    """A row per enabled line rule and added line that it fires on: one pass, all patterns as literals."""
    rules = [r for r in LINE_RULES if config.enabled(r["id"])]
    if not rules:
        return _scanned(views, files).where(F.lit(False)).select("diff_id", F.lit("").alias("rule_id"), F.lit(0).alias("seq"), "file_idx", "added_idx", "path", F.col("n").alias("line"), F.col("raw").alias("snippet"), F.lit(None).cast("string").alias("detail"))
    fired = F.array(*[F.when(_fires(r), F.lit(SEQUENCE.index(r["id"]))) for r in rules])
    ids = F.array(*map(F.lit, SEQUENCE))
    df = _scanned(views, files).withColumns({f"low_{c}": F.lower(c) for c in ("raw", "code", "strings_view", "comment")})
    df = df.withColumn("seq", F.explode(F.filter(fired, lambda x: x.isNotNull())))
    return df.select("diff_id", F.get(ids, F.col("seq")).alias("rule_id"), "seq", "file_idx", "added_idx", "path", F.col("n").alias("line"), truncate(trim(F.col("raw")), 160).alias("snippet"), F.lit(None).cast("string").alias("detail"))


def entropy_candidates(views: DataFrame, files: DataFrame) -> DataFrame:
    best = best_finding(F.col("string_list"))
    # A finding has a run of 18 such characters at least: few lines have one, and only those are taken apart.
    likely = views.where((F.length("strings_view") >= 20) & F.col("strings_view").rlike(r"[A-Za-z0-9+/_\-]{18}"))
    df = _scanned(likely, files).withColumn("best", best).where("best is not null")
    detail = F.concat(F.lit("entropy "), number(F.col("best.entropy")), F.lit(" bits/char"))
    return df.select("diff_id", F.lit("entropy-secret").alias("rule_id"), F.lit(SEQUENCE.index("entropy-secret")).alias("seq"), "file_idx", "added_idx", "path", F.col("n").alias("line"), truncate(trim(F.col("raw")), 160).alias("snippet"), detail.alias("detail"))


def file_conditions() -> dict[str, Column]:
    alive = F.col("status") != "deleted"
    return {
        "test-deleted": ~alive & F.col("is_test"), "secret-file": alive & F.col("is_secret_file"), "dep-change": alive & F.col("is_manifest") & ~F.col("is_lockfile"), "migration": alive & F.col("is_migration"),
        "infra-change": alive & F.col("is_infra"), "large-file-churn": F.col("churn") >= 400, "binary-added": F.col("is_binary") & alive, "lockfile-only-note": alive & F.col("is_lockfile"),
    }


def file_candidates(files: DataFrame, config: Config) -> DataFrame:
    """A row per enabled file rule and file; line 0. File rules have no cap."""
    df = files.select("*", *paths.flags(F.col("path")))
    conds = {k: v for k, v in file_conditions().items() if config.enabled(k)}
    fired = F.array(*[F.when(v, F.lit(SEQUENCE.index(k))) for k, v in conds.items()]) if conds else F.array().cast("array<int>")
    df = df.withColumn("seq", F.explode(F.filter(fired, lambda x: x.isNotNull())))
    rule_id = F.get(F.array(*map(F.lit, SEQUENCE)), F.col("seq"))
    snippet = F.when(rule_id == "large-file-churn", F.concat(F.coalesce(F.col("path"), F.lit("null")), F.lit(" ("), F.col("churn").cast("string"), F.lit(" lines)"))).otherwise(F.col("path"))
    return df.select("diff_id", rule_id.alias("rule_id"), "seq", "file_idx", F.lit(0).alias("added_idx"), "path", F.lit(0).cast("long").alias("line"), snippet.alias("snippet"), F.lit(None).cast("string").alias("detail"))


def capped(marked: DataFrame) -> DataFrame:
    """Hits that are looked at before a rule's cap is reached in its diff: suppressed ones are counted, the others kept."""
    cap = F.get(F.array(*[F.lit(BY_ID[i]["cap"] if i in {r["id"] for r in LINE_RULES} or i == "entropy-secret" else 1 << 30) for i in SEQUENCE]), F.col("seq"))
    order = W.partitionBy("diff_id", "seq").orderBy("file_idx", "added_idx")
    before = F.coalesce(F.sum((~F.col("suppressed")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("kept_before", before).where(F.col("kept_before") < cap).drop("kept_before")


def first_of_line(marked: DataFrame) -> DataFrame:
    """One unsuppressed entropy hit for each path and line."""
    nth = F.row_number().over(W.partitionBy("diff_id", "path", "line").orderBy("file_idx", "added_idx"))
    return marked.withColumn("nth", nth).where(F.col("suppressed") | (F.col("nth") == 1)).drop("nth")


def untested_candidates(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code files touched, verdict per diff): the aggregate over non-test code files of a diff."""
    df = files.select("*", *paths.flags(F.col("path")))
    code = F.col("is_code") & ~F.col("is_test")
    verdict = df.groupBy("diff_id").agg(F.sum(F.when(code, F.col("additions")).otherwise(0)).alias("code_adds"), F.bool_or(F.col("is_test") & (F.col("status") != "deleted")).alias("touched_test"))
    touched = df.where(code & (F.col("churn") > 0)).select("diff_id", F.lit("logic-without-tests").alias("rule_id"), F.lit(SEQUENCE.index("logic-without-tests")).alias("seq"), "file_idx", F.lit(0).alias("added_idx"), "path", F.lit(0).cast("long").alias("line"), F.col("path").alias("snippet"), F.lit(None).cast("string").alias("detail"))
    return touched, verdict.where("code_adds >= 30 and not touched_test").select("diff_id")
