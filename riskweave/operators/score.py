"""Signals, score waterfall, breakdowns and checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskweave.functions.scalars import SEVERITIES, half_up, log2, number, rank, round1, severity_name, weight


def signals(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per diff and rule with kept hits, locations in order, and ord: place in the report."""
    location = F.struct("file_idx", "added_idx", F.col("path").alias("file"), "line", "snippet", "detail")
    by = hits.groupBy("diff_id", "rule_id").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(location)).alias("locations"))
    df = by.join(F.broadcast(rules), "rule_id").withColumn("weight", weight(F.col("severity")))  # rules: the catalog's 47 rows
    order = W.partitionBy("diff_id").orderBy(F.desc(rank(F.col("severity"))), F.desc("count"), "seq")
    slim = F.transform("locations", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["snippet"].alias("snippet"), x["detail"].alias("detail")))
    return df.withColumn("locations", slim).withColumn("ord", F.row_number().over(order))


def signal_points(w: Column, confidence: Column, count: Column) -> Column:
    return w * (0.55 + 0.45 * confidence) * (1 + 0.5 * (F.least(count, F.lit(12)) - 1))


def score_changes(signals: DataFrame, changes: DataFrame) -> DataFrame:
    """Scores and waterfalls of changes (diff_id, churn, files, complexity_delta) from signals (diff_id, severity, confidence, count).

    Columns: points, raw, score, tier, color, worst_rank, n_critical, n_high, steps (array<struct<label, detail, points>>).
    """
    sev = F.col("severity")
    pts = signal_points(weight(sev), F.col("confidence"), F.col("count"))
    exact = pts.cast("decimal(24,9)")  # sums that no order of rows changes
    aggs = [a for s in SEVERITIES for a in (F.sum(F.when(sev == s, exact)).cast("double").alias(f"p_{s}"), F.sum((sev == s).cast("long")).alias(f"n_{s}"))]
    by = signals.groupBy("diff_id").agg(*aggs, F.max(rank(sev)).alias("worst_rank"))
    df = changes.join(by, "diff_id", "left").withColumns({f"n_{s}": F.coalesce(F.col(f"n_{s}"), F.lit(0)) for s in SEVERITIES})
    churn_pts = F.least(F.lit(28.0), log2(F.col("churn") + 1) * 3)
    file_pts = F.least(F.lit(12.0), F.col("files") * 1.5)
    delta = F.coalesce(F.col("complexity_delta"), F.lit(0))
    cplx = F.when(delta > 0, F.least(F.lit(10.0), delta * 0.8)).otherwise(0.0)
    df = df.withColumns({"churn_pts": churn_pts, "file_pts": file_pts.cast("double"), "cplx_pts": cplx.cast("double")})
    shown = lambda c: F.when(F.col(c) > 0.05, F.col(c)).otherwise(0.0)
    points = F.lit(0.0)
    for s in reversed(SEVERITIES):
        points = points + F.coalesce(F.col(f"p_{s}"), F.lit(0.0))
    df = df.withColumn("points", points + shown("churn_pts") + shown("file_pts") + shown("cplx_pts")).withColumn("raw", 100 * (1 - F.exp(-F.col("points") / 55)))
    critical, high = (F.col("n_critical") > 0) & (F.col("raw") < 82), (F.col("n_high") > 0) & (F.col("raw") < 60)
    floored = F.when(critical, 82.0).when((F.col("n_critical") == 0) & high, 60.0).otherwise(F.col("raw"))
    note = F.when(critical, " → Critical-severity floor").when((F.col("n_critical") == 0) & high, " → High-severity floor").otherwise("")
    df = df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), half_up(floored))).cast("int"))
    s = F.col("score")
    tier = F.when(s < 25, "Low").when(s < 55, "Moderate").when(s < 80, "High").otherwise("Critical")
    color = F.when(s < 25, "safe").when(s < 55, "notice").when(s < 80, "warn").otherwise("danger")
    step = lambda label, detail, p: F.struct(F.lit(label).alias("label"), detail.alias("detail"), p.alias("points"))
    steps = []
    for name in reversed(SEVERITIES):
        n = F.col(f"n_{name}")
        steps.append(F.when(n > 0, step(name.capitalize() + " signals", F.concat(n.cast("string"), F.when(n > 1, " rules").otherwise(" rule")), round1(F.col(f"p_{name}")))))
    steps.append(F.when(F.col("churn_pts") > 0.05, step("Change size", F.concat(F.col("churn").cast("string"), F.lit(" lines changed")), round1(F.col("churn_pts")))))
    steps.append(F.when(F.col("file_pts") > 0.05, step("Files touched", F.concat(F.col("files").cast("string"), F.lit(" files")), round1(F.col("file_pts")))))
    steps.append(F.when(F.col("cplx_pts") > 0.05, step("Added complexity", F.concat(F.lit("+"), delta.cast("string"), F.lit(" decision points")), round1(F.col("cplx_pts")))))
    squash = F.concat(F.lit("raw "), number(round1(F.col("points"))), F.lit(" pts → "), half_up(F.col("raw")).cast("string"), note)
    steps.append(step("Squash to 0–100", squash, F.lit(None).cast("double")))
    return df.select("diff_id", "points", "raw", "score", tier.alias("tier"), color.alias("color"), "worst_rank", "n_critical", "n_high", F.array_compact(F.array(*steps)).alias("steps"))


def waterfall(scores: DataFrame) -> DataFrame:
    return scores.select("diff_id", F.posexplode("steps").alias("step_no", "s")).select("diff_id", "step_no", "s.label", "s.detail", "s.points")


def severity_counts(signals: DataFrame, diffs: DataFrame) -> DataFrame:
    by = signals.groupBy("diff_id").agg(*[F.sum(F.when(F.col("severity") == s, F.col("count")).otherwise(0)).alias(s) for s in SEVERITIES])
    return diffs.join(by, "diff_id", "left").select("diff_id", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in SEVERITIES])


def categories(signals: DataFrame) -> DataFrame:
    by = signals.groupBy("diff_id", "category").agg(F.sum("count").cast("long").alias("count"), F.max(rank(F.col("severity"))).alias("r"), F.min("seq").alias("first"))
    place = F.row_number().over(W.partitionBy("diff_id").orderBy(F.desc("r"), F.desc("count"), "first"))
    return by.select("diff_id", "category", "count", severity_name(F.col("r")).alias("top"), place.alias("ord"))


def breakdown(hits: DataFrame, rules: DataFrame, files: DataFrame) -> DataFrame:
    """Risk by path: weights of its hits plus a share for each section's churn; facts of its last section."""
    sev = F.broadcast(rules.select("rule_id", "severity"))
    weighed = hits.where("path is not null and path != ''").join(sev, "rule_id").groupBy("diff_id", "path").agg(F.sum(weight(F.col("severity"))).alias("w"), F.count("*").alias("hits"), F.max(rank(F.col("severity"))).alias("r"))
    sections = files.groupBy("diff_id", "path").agg(
        F.sum(F.least(F.lit(12.0), log2(F.col("churn") + 1) * 2)).alias("c"), F.min("file_idx").alias("first"),
        *[F.max_by(x, "file_idx").alias(x) for x in ("churn", "additions", "deletions", "status", "language")],
    )
    w = weighed.select(F.col("diff_id").alias("d"), F.col("path").alias("p"), "w", "hits", "r")
    df = sections.join(w, (F.col("diff_id") == F.col("d")) & F.col("path").eqNullSafe(F.col("p")), "left")
    df = df.withColumn("points", F.coalesce(F.col("w"), F.lit(0)) + F.col("c"))
    place = F.row_number().over(W.partitionBy("diff_id").orderBy(F.desc("points"), "first"))
    return df.select("diff_id", "path", "points", F.coalesce(F.col("hits"), F.lit(0)).cast("long").alias("hits"), severity_name(F.coalesce(F.col("r"), F.lit(0))).alias("top"), "churn", "additions", "deletions", "status", "language", place.alias("ord"))


def summary(tier: Column, n_critical: Column, n_high: Column) -> Column:
    """One sentence; needs the columns files, additions, deletions, review_minutes."""
    lead = F.when(tier == "Critical", "Do not merge as-is.").when(tier == "High", "Needs a careful review.").when(tier == "Moderate", "Reviewable, with a few things to check.").otherwise("Low-risk change.")
    many = lambda n: F.when(n > 1, "s").otherwise("")
    tail = F.when(n_critical > 0, F.concat(F.lit(" "), n_critical.cast("string"), F.lit(" critical issue"), many(n_critical), F.lit(" found."))).when(n_high > 0, F.concat(F.lit(" "), n_high.cast("string"), F.lit(" high-severity issue"), many(n_high), F.lit(" found."))).otherwise("")
    text = lambda c: F.col(c).cast("string")
    body = F.concat(lead, F.lit(" "), text("files"), F.when(F.col("files") == 1, " file").otherwise(" files"), F.lit(" changed · +"), text("additions"), F.lit(" / −"), text("deletions"), F.lit(" · ~"), text("review_minutes"), F.lit(" min review."), tail)
    return F.when(F.col("files") == 0, "Paste a diff to run the risk radar.").otherwise(body)


# Checklist items in order, with the rules, or the category, that call for them.
CHECKLIST = [
    ("must", "Remove the leftover merge-conflict markers — this code cannot run as written.", ["conflict-markers"]),
    ("must", "Strip the bidirectional Unicode control characters — verify the code reads the same to a human and the compiler.", ["bidi-unicode"]),
    ("must", "Rotate every exposed secret and scrub it from git history — assume it is already leaked.", ["private-key", "provider-token", "aws-key", "secret-file", "generic-secret", "entropy-secret", "jwt", "basic-auth-url"]),
    ("must", "Confirm no untrusted input reaches the flagged execution / query sink; parameterize or sanitize.", ["eval-exec", "shell-injection", "sql-concat", "insecure-deserialize", "nosql-where", "template-injection"]),
    ("must", "Verify HTML/URL sinks are fed only sanitized, scheme-checked content (XSS).", ["raw-html", "js-scheme"]),
    ("must", "Re-enable certificate verification before this touches any real network.", ["tls-off"]),
    ("should", "Validate input-derived paths/URLs against an allow-list (traversal / SSRF).", ["path-traversal", "ssrf"]),
    ("should", "Replace weak crypto/RNG with vetted algorithms (SHA-256+, AES-GCM, CSPRNG).", ["weak-crypto", "insecure-random", "ecb-mode"]),
    ("should", "Remove .only / .skip so the full test suite actually runs.", ["focused-test"]),
    ("should", "Add or restore tests covering the changed behavior.", "Testing"),
    ("should", "Review new/updated dependencies and their changelog; check for typosquats.", ["dep-change"]),
    ("should", "Confirm the migration is reversible and safe under load.", ["migration"]),
    ("should", "Double-check config/CI/CORS changes in a dry run; confirm prod posture.", ["infra-change", "debug-flag", "cors-wildcard"]),
    ("nice", "Clear leftover debug output, TODO/FIXME markers, and stray invisible characters.", ["debug-print", "todo", "zero-width"]),
    ("nice", "Consider splitting the largest files into smaller, focused commits.", ["large-file-churn"]),
]
ALWAYS = ["Does the change actually do what the PR title and description claim?", "Are error paths and edge cases handled, not just the happy path?"]
ONCE_MORE = "Read the diff once more end to end — anything here you would not want to own at 2am?"


def checklist(signals: DataFrame, metrics: DataFrame) -> DataFrame:
    """diff_id, ord, pri, text."""
    by = signals.groupBy("diff_id").agg(F.collect_set("rule_id").alias("ids"), F.collect_set("category").alias("cats"))
    df = metrics.join(by, "diff_id", "left")
    item = lambda pri, text: F.struct(F.lit(pri).alias("pri"), (text if isinstance(text, Column) else F.lit(text)).alias("text"))
    items = []
    for pri, text, needs in CHECKLIST:
        cond = F.array_contains("cats", needs) if isinstance(needs, str) else F.arrays_overlap("ids", F.array(*map(F.lit, needs)))
        items.append(F.when(F.coalesce(cond, F.lit(False)), item(pri, text)))
    deep = F.concat(F.lit("Deeply nested code was added (depth ~"), F.col("max_nesting_added").cast("string"), F.lit(") — consider flattening for readability."))
    items.append(F.when(F.col("max_nesting_added") >= 4, item("nice", deep)))
    items += [item("always", t) for t in ALWAYS] + [F.when(F.col("churn") > 0, item("always", ONCE_MORE))]
    return df.select("diff_id", F.posexplode(F.array_compact(F.array(*items))).alias("ord", "i")).select("diff_id", "ord", "i.pri", "i.text")


def flagged_lines(signals: DataFrame) -> DataFrame:
    """Worst signal of each path and line; among equals the first of the report."""
    spread = signals.select("diff_id", "rule_id", "severity", "ord", F.explode("locations").alias("l")).where("l.line != 0")
    nth = F.row_number().over(W.partitionBy("diff_id", "l.file", "l.line").orderBy(F.desc(rank(F.col("severity"))), "ord"))
    return spread.withColumn("nth", nth).where("nth = 1").select("diff_id", F.col("l.file").alias("path"), F.col("l.line").alias("line"), "rule_id", "severity")


def annotated(lines: DataFrame, files: DataFrame, flags: DataFrame) -> DataFrame:
    """Every line of the diff, with the flag of added ones, and whether its file has any."""
    rows = lines.join(files.select("diff_id", "file_idx", "path"), ["diff_id", "file_idx"])
    f = flags.select(F.col("diff_id").alias("d"), F.col("path").alias("p"), F.col("line").alias("n"), "rule_id", "severity")
    own = rows.join(f, (F.col("type") == "add") & (F.col("diff_id") == F.col("d")) & F.col("path").eqNullSafe(F.col("p")) & (F.col("new_no") == F.col("n")), "left").drop("d", "p", "n")
    any_flag = flags.select(F.col("diff_id").alias("d"), F.col("path").alias("p"), F.lit(True).alias("x")).distinct()
    return own.join(any_flag, (F.col("diff_id") == F.col("d")) & F.col("path").eqNullSafe(F.col("p")), "left").withColumn("file_flagged", F.coalesce(F.col("x"), F.lit(False))).drop("d", "p", "x")

