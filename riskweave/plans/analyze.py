"""The whole analysis: diffs in, a bundle of lazy DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.catalog import rule_table
from riskweave.operators import lex, metrics, parse, rules, score, suppress
from riskweave.plans.config import Config, evaluate_gate
from riskweave.plans.shared import cut


@dataclass
class Report:
    """Every part is keyed by diff_id and built when it is first asked for. Parts that most others read, such as lines and
    views, are written once to the shared scratch folder, so plans stay small and survive lost executors."""

    diffs: DataFrame
    config: Config = Config()
    prefix: str = suppress.DEFAULT_PREFIX

    @cached_property
    def tagged(self) -> DataFrame:
        return cut(parse.tag_lines(self.diffs), "tagged")

    @cached_property
    def lines(self) -> DataFrame:
        return cut(parse.numbered(self.tagged), "lines")

    @cached_property
    def hunks(self) -> DataFrame:
        return parse.hunks(self.tagged)

    @cached_property
    def files(self) -> DataFrame:
        return cut(parse.files(self.tagged, self.lines), "files")

    @cached_property
    def totals(self) -> DataFrame:
        return parse.totals(self.diffs, self.files)

    @cached_property
    def views(self) -> DataFrame:
        return cut(lex.token_views(self.lines, self.files), "views")

    @cached_property
    def suppressions(self) -> DataFrame:
        return suppress.suppressions(self.views, self.files, self.prefix)

    @cached_property
    def rules(self) -> DataFrame:
        return rule_table(self.diffs.sparkSession, self.config.severity)

    @cached_property
    def seen(self) -> DataFrame:
        """Hits looked at before caps, with `suppressed`, and `kept`: does it make a signal."""
        found = rules.line_candidates(self.views, self.files, self.config).unionByName(rules.file_candidates(self.files, self.config))
        mark = lambda df: suppress.mark_suppressed(df, self.suppressions)
        out = rules.capped(mark(found))
        if self.config.enabled("entropy-secret"):
            out = out.unionByName(rules.capped(rules.first_of_line(mark(rules.entropy_candidates(self.views, self.files)))))
        touched, fires = rules.untested_candidates(self.files)
        touched = mark(touched)
        nth = F.row_number().over(rules.W.partitionBy("diff_id", "suppressed").orderBy("file_idx"))
        fires = fires.withColumn("fires", F.lit(self.config.enabled("logic-without-tests")))
        touched = touched.withColumn("nth", nth).join(fires, "diff_id", "left")
        touched = touched.where(F.col("suppressed") | F.coalesce(F.col("fires"), F.lit(False)) & (F.col("nth") <= 8)).drop("nth", "fires")
        return cut(out.unionByName(touched).withColumn("kept", ~F.col("suppressed")), "seen")

    @cached_property
    def hits(self) -> DataFrame:
        return self.seen.where("kept").drop("kept", "suppressed")

    @cached_property
    def suppressed(self) -> DataFrame:
        return self.seen.where("suppressed").groupBy("diff_id").agg(F.count("*").alias("suppressed"))

    @cached_property
    def signals(self) -> DataFrame:
        return cut(score.signals(self.hits, self.rules), "signals")

    @cached_property
    def metrics(self) -> DataFrame:
        return cut(metrics.change_metrics(self.totals, self.files, self.lines, self.views), "metrics")

    @cached_property
    def languages(self) -> DataFrame:
        return metrics.language_mix(self.files)

    @cached_property
    def scores(self) -> DataFrame:
        scored = score.score_changes(self.signals, self.metrics.select("diff_id", "churn", "files", "complexity_delta"))
        df = scored.join(self.metrics.select("diff_id", "files", "additions", "deletions", "review_minutes"), "diff_id").join(self.suppressed, "diff_id", "left").withColumn("suppressed", F.coalesce(F.col("suppressed"), F.lit(0)))
        df = df.withColumn("summary", score.summary(F.col("tier"), F.col("n_critical"), F.col("n_high"))).select("diff_id", "points", "raw", "score", "tier", "color", "worst_rank", "n_critical", "n_high", "steps", "suppressed", "summary")
        return cut(df, "scores")

    @cached_property
    def waterfall(self) -> DataFrame:
        return score.waterfall(self.scores)

    @cached_property
    def counts(self) -> DataFrame:
        return score.severity_counts(self.signals, self.totals.select("diff_id"))

    @cached_property
    def categories(self) -> DataFrame:
        return score.categories(self.signals)

    @cached_property
    def breakdown(self) -> DataFrame:
        return score.breakdown(self.hits, self.rules, self.files)

    @cached_property
    def checklist(self) -> DataFrame:
        return score.checklist(self.signals, self.metrics)

    @cached_property
    def flags(self) -> DataFrame:
        return score.flagged_lines(self.signals)

    @cached_property
    def annotated(self) -> DataFrame:
        return score.annotated(self.lines, self.files, self.flags)

    @cached_property
    def gate(self) -> DataFrame:
        return evaluate_gate(self.scores, self.config.gate)


def analyze_parsed(files: DataFrame, lines: DataFrame, hunks: DataFrame | None = None, config: Config | None = None, **options) -> Report:
    """A report of changes that were parsed before, by `operators.parse` or by others into the same columns."""
    report = Report(files.select("diff_id").distinct(), config or Config(), **options)
    given = {"files": files, "lines": lines} | ({"hunks": hunks} if hunks is not None else {})
    report.__dict__.update(given)  # cached properties that are already known
    return report


def analyze(diffs: DataFrame, config: Config | None = None, **options) -> Report:
    """diffs: diff_id, diff_text; one row is one change."""
    return Report(diffs, config or Config(), **options)
