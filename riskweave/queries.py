"""Registered queries of the engine, over diffs rendered from the documents table, and their oracles.

Spark parses the rendered diffs (`rendered`); the oracles (`oracles`) start from the rows they were rendered from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import oracles as sql
from riskweave import rendered
from riskweave.functions import paths
from riskweave.operators import score
from riskweave.plans import export, page
from riskweave.plans.analyze import Report, analyze, analyze_parsed
from riskweave.plans.config import Config, evaluate_gate
from riskweave.sources.diffs import input_size

#: A configuration that turns rules off and changes severities.
CHANGED = Config(disabled={"todo": True, "long-line": True, "infra-change": True, "zero-width": False}, severity={"debug-print": "high", "dep-change": "info", "migration": "critical"})

# Numeric records of orders as changes, to check the score formulas on many rows.
_SQL_SCORED = """
with sig as (select l_orderkey as diff_id, case l_linenumber % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'info' end as severity, case l_linenumber % 4 when 0 then 4 when 1 then 10 when 2 then 22 else 0 end as weight,
        l_discount * 10 as confidence, cast(l_quantity as bigint) as n from lineitem),
agg as (select diff_id, sum(weight * (0.55 + 0.45 * confidence) * (1 + 0.5 * (least(n, 12) - 1))) as pts, count(*) filter (severity = 'high') as n_high,
        max(case severity when 'info' then 0 when 'low' then 1 when 'medium' then 2 else 3 end) as worst from sig group by diff_id),
chg as (select l_orderkey as diff_id, cast(sum(cast(l_quantity as bigint)) as bigint) as churn, cast(count(*) as bigint) as files, cast(max(l_suppkey % 20) - 8 as bigint) as delta from lineitem group by 1),
p as (select diff_id, worst, coalesce(n_high, 0) as n_high, coalesce(pts, 0) + least(28, 3 * log2(churn + 1)) + least(12, 1.5 * files) + case when delta > 0 then least(10, 0.8 * delta) else 0 end as points from chg left join agg using (diff_id)),
s as (select *, 100 * (1 - exp(-points / 55)) as raw from p),
f as (select *, cast(floor(case when n_high > 0 and raw < 60 then 60 else raw end + 0.5) as integer) as score from s)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k = F.col("l_linenumber") % 4
    sev = F.when(k == 0, "low").when(k == 1, "medium").when(k == 2, "high").otherwise("info")
    signals = li.select(F.col("l_orderkey").alias("diff_id"), sev.alias("severity"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_quantity").cast("long").alias("count"))
    changes = li.groupBy(F.col("l_orderkey").alias("diff_id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("churn"), F.count("*").alias("files"), (F.max(F.col("l_suppkey") % 20) - 8).alias("complexity_delta"))
    return score.score_changes(signals, changes)


def _report(config: Config | None = None):
    def wrap(part: Callable[[Report], DataFrame]):
        return lambda spark, sf_dir: part(analyze(rendered.diffs(spark, sf_dir), config))

    return wrap


def _json_signals(report: Report) -> DataFrame:
    """What a reader of the JSON reports finds: a row per signal, and one with nulls for a report without any."""
    schema = "score int, tier string, signals array<struct<id:string,severity:string,count:bigint,cwe:string,locations:array<struct<file:string,line:bigint>>>>, checklist array<struct<pri:string,text:string>>"
    df = export.json_report(report).select("diff_id", F.from_json("report", schema).alias("r")).select("diff_id", "r.score", "r.tier", F.size("r.checklist").alias("n_checks"), F.explode_outer("r.signals").alias("s"))
    return df.select("diff_id", "score", "tier", "n_checks", "s.id", "s.severity", F.col("s.count").alias("n_hits"), "s.cwe", F.when(F.col("s.id").isNotNull(), F.size("s.locations")).alias("n_places"), F.get("s.locations", 0)["line"].alias("first_line"))


def _sarif_results(report: Report) -> DataFrame:
    """What a reader of the SARIF reports finds: a row per result, with its rule's severity as a number."""
    place = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>"
    rule = "struct<id:string,properties:struct<`security-severity`:string>>"
    schema = f"version string, runs array<struct<tool:struct<driver:struct<rules:array<{rule}>>>,results:array<struct<ruleId:string,ruleIndex:int,level:string,rank:int,locations:array<{place}>>>>>"
    df = export.sarif(report).select("diff_id", F.from_json("report", schema).alias("r")).select("diff_id", "r.version", F.get("r.runs", 0).alias("run"))
    df = df.select("diff_id", "version", F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("x"))
    rule_, at = F.get("rules", F.col("x.ruleIndex")), F.get("x.locations", 0)["physicalLocation"]
    return df.select("diff_id", "version", F.col("x.ruleId").alias("rule_id"), rule_["id"].alias("indexed_id"), rule_["properties"]["security-severity"].alias("weight"), "x.level", "x.rank", at["artifactLocation"]["uri"].alias("uri"), at["region"]["startLine"].alias("start_line"))


def _parsed_again(spark: SparkSession, sf_dir: str) -> Report:
    first = analyze(rendered.diffs(spark, sf_dir))
    return analyze_parsed(first.files, first.lines, first.hunks)


_FULL, _CHANGED = _report(), _report(CHANGED)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "risk_scores": _FULL(lambda r: r.scores.select("diff_id", F.round("points", 6).alias("points"), "score", "tier", "color", "suppressed", "summary")),
    "diff_totals": _FULL(lambda r: r.totals),
    "file_status_lang": _FULL(lambda r: r.files.select("diff_id", "file_idx", "old_path", "new_path", "path", "status", "language", "is_binary", "is_rename", "is_copy", "is_combined", "additions", "deletions", "churn")),
    "hunk_lines_numbered": _FULL(lambda r: r.lines.select("diff_id", "file_idx", "hunk_idx", "type", "text", "old_no", "new_no", "added_idx")),
    "hunk_headers": _FULL(lambda r: r.hunks),
    "path_classes": _FULL(lambda r: r.files.select("diff_id", "file_idx", *paths.flags(F.col("path")))),
    "token_views": _FULL(lambda r: r.views.withColumn("string_list", F.array_join("string_list", "¦"))),
    "all_hits": _FULL(lambda r: r.hits),
    "entropy_tokens": _FULL(lambda r: r.hits.where("rule_id = 'entropy-secret'").select("diff_id", "path", "line", "detail")),
    "logic_without_tests": _FULL(lambda r: r.hits.where("rule_id = 'logic-without-tests'").select("diff_id", "path")),
    "suppressed_hits": _FULL(lambda r: r.seen.where("suppressed").select("diff_id", "rule_id", "path", "line")),
    "capped_signals": _FULL(lambda r: r.signals.select("diff_id", "rule_id", "category", "severity", F.col("count").alias("n_hits"), "ord")),
    "changed_rules": _CHANGED(lambda r: r.signals.select("diff_id", "rule_id", "severity", F.col("count").alias("n_hits"))),
    "severity_counts": _FULL(lambda r: r.counts),
    "category_rollup": _FULL(lambda r: r.categories.select("diff_id", "category", F.col("count").alias("n_hits"), "top")),
    "file_breakdown": _FULL(lambda r: r.breakdown.select("diff_id", "path", F.round("points", 6).alias("points"), "hits", "top", "churn", "status")),
    "language_mix": _FULL(lambda r: r.languages.select("diff_id", "language", "churn", "percent")),
    "change_metrics": _FULL(lambda r: r.metrics),
    "waterfall_steps": _FULL(lambda r: r.waterfall),
    "flagged_lines": _FULL(lambda r: r.flags),
    "annotated_diff": _FULL(lambda r: r.annotated.select("diff_id", "file_idx", "type", "text", "old_no", "new_no", "path", "rule_id", "severity", "file_flagged")),
    "checklist": _FULL(lambda r: r.checklist),
    "sarif_results": _FULL(export.sarif_results),
    "report_markdown": _FULL(export.markdown),
    "report_json": _FULL(export.json_report),
    "report_sarif": _FULL(export.sarif),
    "report_text": _FULL(export.text_report),
    "report_html": _FULL(page.html),
    "waterfall_bars": _FULL(lambda r: page.waterfall_bars(r.waterfall)),
    "rule_settings": _CHANGED(lambda r: page.rule_settings(r.rules, r.config.disabled)),
    "input_lines": _FULL(lambda r: input_size(r.diffs).select("diff_id", "n_lines")),
    "parsed_again": lambda spark, sf_dir: _parsed_again(spark, sf_dir).scores.select("diff_id", F.round("points", 6).alias("points"), "score", "tier", "color", "suppressed", "summary"),
    "json_read_back": _FULL(_json_signals),
    "sarif_read_back": _FULL(_sarif_results),
    "numeric_scores": lambda spark, sf_dir: _scored(spark, sf_dir).select("diff_id", F.round("points", 6).alias("points"), "score", "tier"),
    "gate_verdicts": lambda spark, sf_dir: evaluate_gate(_scored(spark, sf_dir), {"failOn": "high", "maxScore": 70}).select("diff_id", "failed", F.concat_ws("; ", "reasons").alias("reasons")),
}
ORACLES: dict[str, str] = {
    "risk_scores": sql.SCORES + " select diff_id, round(points, 6) as points, score, tier, color, suppressed, summary from score",
    "diff_totals": sql.METRICS + " select diff_id, files, additions, deletions, churn from total",
    "file_status_lang": sql.BASE + """ select diff_id, file_idx, case when k in (2, 3) then 'd' || doc_id || '/was.txt' when k = 0 then '/dev/null' else path end as old_path, case when k = 1 then '/dev/null' else path end as new_path,
        path, status, language, is_binary, k = 2 as is_rename, k = 3 as is_copy, k = 5 as is_combined, additions, deletions, churn from file""",
    "hunk_lines_numbered": sql.BASE + " select diff_id, file_idx, 0 as hunk_idx, type, text, cast(old_no as bigint) as old_no, cast(new_no as bigint) as new_no, added_idx from line",
    "hunk_headers": sql.BASE + """, h as (select diff_id, file_idx, k, cast(len(lines) as bigint) as n from file where k not in (4, 6))
        select diff_id, file_idx, 0 as hunk_idx, case k when 1 then '@@ -1,' || n || ' +0,0 @@' when 5 then '@@@ -1,0 -1,0 +1,' || n || ' @@@' when 10 then '@@ -5,2 +5,' || (n + 1) || ' @@ def f():' else '@@ -0,0 +1,' || n || ' @@' end as header,
        cast(case k when 1 then 1 when 5 then 1 when 10 then 5 else 0 end as bigint) as old_start, cast(case k when 1 then n when 10 then 2 else 0 end as bigint) as old_lines,
        cast(case k when 1 then 0 when 10 then 5 else 1 end as bigint) as new_start, cast(case k when 1 then 0 when 10 then n + 1 else n end as bigint) as new_lines, case when k = 5 then 2 else 1 end as marker_cols from h""",
    "path_classes": sql.FLAGGED + " select diff_id, file_idx, is_test, is_code, is_manifest, is_infra, is_migration, is_secret_file, is_lockfile, js_like from flagged",
    "token_views": sql.VIEWS + " select diff_id, file_idx, added_idx, n, raw, code, strings_view, array_to_string(string_list, '¦') as string_list, comment, in_string from views",
    "all_hits": sql.HITS + " select diff_id, rule_id, seq, file_idx, added_idx, path, line, snippet, detail from hit",
    "entropy_tokens": sql.HITS + " select diff_id, path, line, detail from hit where rule_id = 'entropy-secret'",
    "logic_without_tests": sql.HITS + " select diff_id, path from hit where rule_id = 'logic-without-tests'",
    "suppressed_hits": sql.HITS + " select diff_id, rule_id, path, line from seen where suppressed",
    "capped_signals": sql.METRICS + " select diff_id, rule_id, category, severity, n_hits, cast(ord as integer) as ord from ordered",
    "changed_rules": sql.METRICS + f""" select diff_id, rule_id, case rule_id {" ".join(f"when '{k}' then '{v}'" for k, v in CHANGED.severity.items())} else severity end as severity, n_hits
        from signal where rule_id not in ({", ".join(f"'{k}'" for k, v in CHANGED.disabled.items() if v)})""",
    "severity_counts": sql.METRICS + " select t.diff_id, " + ", ".join(f"cast(coalesce(sum(n_hits) filter (severity = '{s}'), 0) as bigint) as {s}" for s in sql.WEIGHTS) + " from total t left join signal s on t.diff_id = s.diff_id group by t.diff_id",
    "category_rollup": sql.METRICS + f" select diff_id, category, n_hits, {sql.SEVERITY} as top from (select diff_id, category, cast(sum(n_hits) as bigint) as n_hits, max(sev_rank) as r from signal group by all)",
    "file_breakdown": sql.METRICS + f""", w as (select diff_id, path, sum(weight) as w, count(*) as hits, max(sev_rank) as r from hit join rule using (rule_id) where path <> '' group by all)
        select diff_id, path, round(coalesce(w, 0) + least(12, 2 * log2(churn + 1)), 6) as points, cast(coalesce(hits, 0) as bigint) as hits, {sql.SEVERITY.replace("case r", "case coalesce(r, 0)")} as top, churn, status from file left join w using (diff_id, path)""",
    "language_mix": sql.BASE + """, l as (select diff_id, language, cast(sum(churn) as bigint) as churn from file group by all)
        select diff_id, language, churn, cast(case when sum(churn) over (partition by diff_id) > 0 then floor(churn / sum(churn) over (partition by diff_id) * 100 + 0.5) else 0 end as bigint) as percent from l""",
    "change_metrics": sql.METRICS + """ select diff_id, files, additions, deletions, churn, cast(complexity_delta as bigint) as complexity_delta, decisions_added, decisions_removed, cast(max_nesting_added as bigint) as max_nesting_added,
        cast(comment_ratio as double) as comment_ratio, comment_lines, code_lines, test_files, code_files, cast(review_minutes as bigint) as review_minutes from metrics""",
    "waterfall_steps": sql.SCORES + " select diff_id, step_no, label, detail, points from step",
    "flagged_lines": sql.SCORES + " select diff_id, path, line, rule_id, severity from flag",
    "annotated_diff": sql.SCORES + """ select l.diff_id, l.file_idx, l.type, l.text, cast(l.old_no as bigint) as old_no, cast(l.new_no as bigint) as new_no, l.path, f.rule_id, f.severity,
        exists (select 1 from flag g where g.diff_id = l.diff_id and g.path is not distinct from l.path) as file_flagged
        from line l left join flag f on l.type = 'add' and f.diff_id = l.diff_id and f.path is not distinct from l.path and f.line = l.new_no""",
    "checklist": sql.CHECKS + " select diff_id, ord, pri, text from checks",
    "sarif_results": sql.SCORES + """ select h.diff_id, h.rule_id, cast(o.ord - 1 as integer) as rule_index, case when o.sev_rank >= 3 then 'error' when o.sev_rank >= 1 then 'warning' else 'note' end as level,
        case o.sev_rank when 4 then 100 when 3 then 80 when 2 then 50 when 1 then 20 else 5 end as rank, coalesce(h.path, 'unknown') as uri, cast(case when h.line <> 0 then h.line else 1 end as bigint) as start_line from hit h join ordered o using (diff_id, rule_id)""",
    "report_markdown": sql.markdown(export.TOOL),
    "waterfall_bars": sql.SCORES + " select diff_id, step_no, label, greatest(2, cast(floor(points / greatest(1, max(points) over (partition by diff_id)) * 100 + 0.5) as bigint)) as width from step where points is not null",
    "rule_settings": f"""select category, rule_id, title, rule_id not in ({", ".join(f"'{k}'" for k, v in CHANGED.disabled.items() if v)}) as enabled,
        case rule_id {" ".join(f"when '{k}' then '{v}'" for k, v in CHANGED.severity.items())} else severity end as severity, seq from (values {sql.CATALOG}) as t(rule_id, title, category, severity, seq)""",
    "input_lines": sql.BASE + """ select diff_id, cast(sum(len(lines) + case k when 0 then 5 when 1 then 5 when 2 then 7 when 3 then 6 when 4 then 3 when 5 then 5 when 6 then 3 when 7 then 5 when 8 then 3 when 9 then 1 when 10 then 6 else 4 end) as bigint) as n_lines
        from file group by diff_id""",
    "parsed_again": sql.SCORES + " select diff_id, round(points, 6) as points, score, tier, color, suppressed, summary from score",
    "report_text": sql.text(export.TOOL),
    "json_read_back": sql.CHECKS + """, first as (select diff_id, rule_id, cast(count(*) as integer) as n_places, arg_min(line, (file_idx, added_idx, path, line)) as first_line from hit group by diff_id, rule_id),
        n as (select diff_id, cast(count(*) as integer) as n_checks from checks group by diff_id)
        select c.diff_id, c.score, c.tier, n.n_checks, o.rule_id as id, o.severity, o.n_hits, o.cwe, f.n_places, f.first_line from score c join n using (diff_id) left join ordered o using (diff_id) left join first f on f.diff_id = o.diff_id and f.rule_id = o.rule_id""",
    "sarif_read_back": sql.SCORES + """ select h.diff_id, '2.1.0' as version, h.rule_id, h.rule_id as indexed_id, list_extract(['0.5', '2', '5', '8', '10'], o.sev_rank + 1) as weight, case when o.sev_rank >= 3 then 'error' when o.sev_rank >= 1 then 'warning' else 'note' end as level,
        case o.sev_rank when 4 then 100 when 3 then 80 when 2 then 50 when 1 then 20 else 5 end as rank, coalesce(h.path, 'unknown') as uri, cast(case when h.line <> 0 then h.line else 1 end as bigint) as start_line from hit h join ordered o using (diff_id, rule_id)""",
    "numeric_scores": _SQL_SCORED + " select diff_id, round(points, 6) as points, score, case when score < 25 then 'Low' when score < 55 then 'Moderate' when score < 80 then 'High' else 'Critical' end as tier from f",
    "gate_verdicts": _SQL_SCORED + """ select diff_id, score > 70 or coalesce(worst, -1) >= 3 as failed,
        concat_ws('; ', case when score > 70 then 'score ' || score || ' exceeds maxScore 70' end, case when worst >= 3 then 'high-severity signal at or above failOn threshold high' end) as reasons from f""",
}
