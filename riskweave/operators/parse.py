"""Unified diffs to files, hunks and numbered lines, with window functions over each diff's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from riskweave.functions import paths
from riskweave.functions.dialect import JS_WS
from riskweave.functions.scalars import trim

HUNK = r"^(@{2,}) ([^\n\r\x{2028}\x{2029}]+?) \1"


def clean_path(p: Column) -> Column:
    """Trim, unquote, and strip one a/ or b/."""
    p = trim(p)
    p = F.when((F.length(p) > 1) & p.startswith('"') & p.endswith('"'), F.substring(p, F.lit(2), F.length(p) - 2)).otherwise(p)
    return F.regexp_replace(p, "^[ab]/", "")


def after(line: Column, n: int) -> Column:
    return F.substring(line, n + 1, 1 << 30)


def _number(token: Column) -> Column:
    """Leading integer of a text, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(token, r"^[+-]?[0-9]+", 0), F.lit("")).cast("long"), F.lit(0))


def _range(token: Column) -> tuple[Column, Column]:
    parts = F.split(after(token, 1), ",")
    return _number(F.get(parts, 0)), F.when(F.size(parts) < 2, F.lit(1)).otherwise(_number(F.get(parts, 1)))


def tag_lines(diffs: DataFrame) -> DataFrame:
    """Each diff's lines from its first file on: diff_id, pos, line, kind, file_idx, value (a path), hunk (its header's numbers)."""
    text = F.regexp_replace(F.col("diff_text"), r"\r\n?", "\n")
    rows = diffs.where(F.length(trim(F.col("diff_text"))) > 0).select("diff_id", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    line = F.col("line")
    begins = lambda *heads: [line.startswith(h) for h in heads]
    any_of = lambda conds: conds[0] if len(conds) == 1 else conds[0] | any_of(conds[1:])
    git, combined = line.startswith("diff --git "), any_of(begins("diff --cc ", "diff --combined "))
    hunkish = line.startswith("@") & line.rlike(HUNK)
    order = W.partitionBy("diff_id").orderBy("pos")
    rows = rows.withColumn("hunkish", hunkish).withColumn("explicit", git | combined).withColumn("n_explicit", F.sum(F.col("explicit").cast("int")).over(order))
    rows = rows.withColumn("lazy", (F.col("n_explicit") == 0) & (line.startswith("--- ") | F.col("hunkish")))
    rows = rows.withColumn("n_lazy", F.sum(F.col("lazy").cast("int")).over(order))
    rows = rows.withColumn("file_idx", (F.sum((F.col("explicit") | F.col("lazy") & (F.col("n_lazy") == 1)).cast("int")).over(order) - 1).cast("int")).where("file_idx >= 0")
    groups = F.split(F.regexp_extract(line, HUNK, 2), f"[{JS_WS}]+")
    last = lambda sign: F.filter(groups, lambda g: g.startswith(sign))
    pick = lambda a: F.get(a, F.size(a) - 1)
    plus, minus = pick(last("+")), pick(last("-"))
    (new_start, new_lines), (old_start, old_lines) = _range(plus), _range(minus)
    hunk = F.struct(
        F.col("pos").alias("at"), F.coalesce(old_start, F.lit(0)).alias("old_start"), F.when(minus.isNull(), F.lit(0)).otherwise(old_lines).cast("long").alias("old_lines"),
        new_start.alias("new_start"), new_lines.cast("long").alias("new_lines"), (F.length(F.regexp_extract(line, "^@+", 0)) - 1).cast("int").alias("marker_cols"),
    )
    kind = F.when(git, "git").when(combined, "combined")
    for name, heads in (
        ("skip", ("old mode ", "new mode ")), ("deleted", ("deleted file mode",)), ("added", ("new file mode",)), ("rename_from", ("rename from ",)), ("rename_to", ("rename to ",)),
        ("copy_from", ("copy from ",)), ("copy_to", ("copy to ",)), ("skip", ("similarity index", "dissimilarity index", "index ")), ("binary", ("Binary files", "GIT binary patch")),
        ("old", ("--- ",)), ("new", ("+++ ",)),
    ):
        kind = kind.when(any_of(begins(*heads)), name)
    kind = kind.when(F.col("hunkish") & plus.isNotNull(), "hunk").when(F.col("hunkish"), "bad_hunk").otherwise("body")
    rows = rows.withColumn("kind", kind)
    stamped = lambda n: F.substring_index(after(line, n), "\t", 1)
    k = F.col("kind")
    value = F.when(k.isin("rename_from"), after(line, 12)).when(k.isin("rename_to", "copy_from"), after(line, 10)).when(k == "copy_to", after(line, 8)).when(k.isin("old", "new"), stamped(4))
    value = value.when(k == "combined", F.regexp_replace(line, "^diff --[a-z]+ ", ""))
    return rows.withColumn("value", clean_path(value)).withColumn("hunk", F.when(k == "hunk", hunk)).select("diff_id", "pos", "line", "kind", "file_idx", "value", "hunk")


def numbered(tagged: DataFrame) -> DataFrame:
    """lines: diff_id, file_idx, hunk_idx, pos, type (add, del, ctx), text, old_no, new_no, added_idx."""
    in_file = W.partitionBy("diff_id", "file_idx").orderBy("pos")
    k = F.col("kind")
    state = F.when(k == "hunk", F.struct(F.lit(True).alias("ok"), "hunk")).when(k == "bad_hunk", F.struct(F.lit(False).alias("ok"), "hunk"))
    rows = tagged.where(k.isin("hunk", "bad_hunk", "body")).withColumn("state", F.last(state, ignorenulls=True).over(in_file))
    rows = rows.withColumn("hunk_idx", (F.sum((k == "hunk").cast("int")).over(in_file) - 1).cast("int"))
    rows = rows.where((k == "body") & F.col("state.ok") & ~F.col("line").startswith("\\"))
    cols = F.col("state.hunk.marker_cols")
    marks = F.substring("line", F.lit(1), cols)
    kind = F.when(marks.contains("+"), "add").when(marks.contains("-"), "del").otherwise("ctx")
    rows = rows.select("diff_id", "file_idx", "hunk_idx", "pos", kind.alias("type"), F.substring("line", cols + 1, F.lit(1 << 30)).alias("text"), F.col("state.hunk.old_start").alias("o"), F.col("state.hunk.new_start").alias("n"))
    before = W.partitionBy("diff_id", "file_idx", "hunk_idx").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    seen = lambda skip: F.coalesce(F.sum((F.col("type") != skip).cast("long")).over(before), F.lit(0))
    rows = rows.withColumn("old_no", F.when(F.col("type") != "add", F.col("o") + seen("add"))).withColumn("new_no", F.when(F.col("type") != "del", F.col("n") + seen("del")))
    added = F.sum((F.col("type") == "add").cast("int")).over(in_file) - 1
    return rows.withColumn("added_idx", F.when(F.col("type") == "add", added.cast("int"))).drop("o", "n")


def hunks(tagged: DataFrame) -> DataFrame:
    idx = F.row_number().over(W.partitionBy("diff_id", "file_idx").orderBy("pos")) - 1
    return tagged.where("kind = 'hunk'").select("diff_id", "file_idx", idx.alias("hunk_idx"), F.col("line").alias("header"), *(F.col(f"hunk.{c}").alias(c) for c in ("old_start", "old_lines", "new_start", "new_lines", "marker_cols")))


def files(tagged: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per file section, with paths, status, language and counts."""
    k, pos = F.col("kind"), F.col("pos")
    halves = r"^diff --git ([^\n\r]+) ([^\n\r]+)\z"
    split = lambda g: F.when(F.col("line").rlike(halves), clean_path(F.regexp_extract("line", halves, g)))
    old = F.when(k == "git", split(1)).when(k.isin("rename_from", "copy_from", "old"), F.col("value"))
    new = F.when(k == "git", split(2)).when(k.isin("rename_to", "copy_to", "new", "combined"), F.col("value"))
    said = tagged.where(k.isin("git", "combined", "deleted", "added", "rename_from", "rename_to", "copy_from", "copy_to", "binary", "old", "new", "hunk", "bad_hunk"))
    by = said.groupBy("diff_id", "file_idx").agg(
        F.max_by(old, F.when(old.isNotNull(), pos)).alias("old_path"), F.max_by(new, F.when(new.isNotNull(), pos)).alias("new_path"), F.max_by(k, F.when(k.isin("deleted", "added"), pos)).alias("mode"),
        F.bool_or(k == "binary").alias("is_binary"), F.bool_or(k.isin("rename_from", "rename_to")).alias("is_rename"), F.bool_or(k.isin("copy_from", "copy_to")).alias("is_copy"), F.bool_or(k == "combined").alias("is_combined"),
    )
    path = F.when(F.col("new_path").isNotNull() & ~F.col("new_path").isin("", "/dev/null"), F.col("new_path")).otherwise(F.col("old_path"))
    status = (
        F.when(F.col("old_path") == "/dev/null", "added").when(F.col("new_path") == "/dev/null", "deleted").when(F.col("is_rename"), "renamed").when(F.col("is_copy"), "copied")
        .when(F.col("is_binary"), "binary").otherwise(F.coalesce(F.col("mode"), F.lit("modified")))
    )
    counts = lines.groupBy("diff_id", "file_idx").agg(F.sum((F.col("type") == "add").cast("long")).alias("additions"), F.sum((F.col("type") == "del").cast("long")).alias("deletions"))
    out = by.join(counts, ["diff_id", "file_idx"], "left").withColumn("path", path)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        "diff_id", "file_idx", "old_path", "new_path", "path", status.alias("status"), paths.language(F.col("path")).alias("language"), "is_binary", "is_rename", "is_copy", "is_combined",
        zero("additions").alias("additions"), zero("deletions").alias("deletions"), (zero("additions") + zero("deletions")).alias("churn"),
    )


def totals(diffs: DataFrame, files: DataFrame) -> DataFrame:
    """files, additions, deletions, churn of every diff, zeros for one without files."""
    by = files.groupBy("diff_id").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.sum("churn").alias("churn"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("files", "additions", "deletions", "churn")]
    return diffs.select("diff_id").distinct().join(by, "diff_id", "left").select("diff_id", *zero)
