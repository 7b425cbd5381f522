"""Code, string and comment views of added lines.

A file's added lines, joined by newlines, are cut into segments by one pattern per syntax family whose alternatives stand
in order of precedence: line comment, block comment, string, other. The views are transforms of the segments, split back
into lines. Sections of one path are lexed by themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Comment and string syntax of each family, and the family of each language.
FAMILIES = {
    "c_like": (["//"], [("/*", "*/")], ['"', "'", "`"]),
    "sql": (["--", "//"], [("/*", "*/")], ['"', "'", "`"]),
    "python": (["#"], [('"""', '"""'), ("'''", "'''")], ['"', "'"]),
    "ruby": (["#"], [("=begin", "=end")], ['"', "'"]),
    "hash": (["#"], [], ['"', "'"]),
    "html": ([], [("<!--", "-->")], ['"', "'"]),
    "php": (["//", "#"], [("/*", "*/")], ['"', "'"]),
    "prose": ([], [], []),
    "json": ([], [], ['"']),
    "generic": (["//", "#"], [("/*", "*/")], ['"', "'", "`"]),
}
LANGUAGE_FAMILY = {
    "c_like": [
        "JavaScript", "TypeScript", "Java", "C", "C++", "C#", "Go", "Rust", "Swift", "Kotlin", "Scala", "Dart", "Vue", "Svelte", "Terraform", "Gradle", "Protobuf", "CSS", "SCSS", "Less",
    ],
    "sql": ["SQL"],
    "python": ["Python"],
    "ruby": ["Ruby"],
    "hash": ["Shell", "PowerShell", "YAML", "TOML", "Dockerfile", "Makefile", "Dotenv"],
    "html": ["HTML", "XML"],
    "php": ["PHP"],
    "prose": ["Markdown"],
    "json": ["JSON"],
}
SEP = "\u0001"


def family(language: Column) -> Column:
    out = None
    for name, langs in LANGUAGE_FAMILY.items():
        cond = language.isin(langs)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("generic")


def _quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", s)


def segment_pattern(name: str) -> str:
    line, block, quotes = FAMILIES[name]
    parts = [_quote(t) + r"[^\n]*+" for t in line]
    parts += [f"{_quote(a)}(?s:.*?)(?:{_quote(b)}|\\z)" for a, b in block]
    parts += [f"{q}[^{q}\\\\\\n]*+(?:\\\\[^\\n]?[^{q}\\\\\\n]*+)*+{q}?" for q in quotes]
    special = "".join(dict.fromkeys(t[0] for t in [*line, *(a for a, _ in block), *quotes]))
    parts += [f"[^{_quote(special)}\\n]++"] if special else [r"[^\n]++"]
    return "(" + "|".join([*parts, r"(?s:.)"]) + ")"


def closed_string(q: str) -> str:
    """A whole literal with both its quotes."""
    return f"{q}[^{q}\\\\\\n]*+(?:\\\\[^\\n][^{q}\\\\\\n]*+)*+{q}"


def _starts(seg: Column, heads: list[str]) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | seg.startswith(h)
    return out


def _streams(name: str, segs: Column) -> Column:
    """Struct of code, strings, comments and open ends, each with the text's newlines."""
    line, block, quotes = FAMILIES[name]
    blank = lambda s: F.regexp_replace(F.regexp_replace(s, r"[\x{10000}-\x{10FFFF}]", "  "), r"[^\n]", " ")
    newlines = lambda s: F.regexp_replace(s, r"[^\n]", "")
    is_block = lambda s: _starts(s, [a for a, _ in block])
    comment = lambda s: _starts(s, line) | is_block(s)
    string = lambda s: _starts(s, quotes) & ~comment(s)
    closed_at = "|".join(map(closed_string, quotes)) or "(?!)"
    closed = lambda s: s.rlike(f"^(?:{closed_at})\\z")
    body = lambda s: F.when(closed(s), F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(F.substring(s, 2, 1 << 30))

    def inner(s: Column) -> Column:
        out = s
        for a, b in block:
            ended = s.endswith(b) & (F.length(s) >= len(a) + len(b))
            text = F.when(ended, F.substring(s, F.lit(len(a) + 1), F.length(s) - len(a) - len(b))).otherwise(F.substring(s, len(a) + 1, 1 << 30))
            out = F.when(s.startswith(a), F.concat(F.replace(text, F.lit("\n"), F.lit(SEP + "\n")), F.lit(SEP))).otherwise(out)
        return F.when(_starts(s, line), F.concat(s, F.lit(SEP))).otherwise(out)

    join = lambda f: F.array_join(F.transform(segs, f), "")
    return F.struct(
        join(lambda s: F.when(comment(s) | string(s), blank(s)).otherwise(s)).alias("code"),
        join(lambda s: F.when(string(s), F.concat(body(s), F.lit(SEP))).otherwise(newlines(s))).alias("strings"),
        join(lambda s: F.when(comment(s), inner(s)).otherwise(newlines(s))).alias("comments"),
        join(lambda s: F.when(string(s) & ~closed(s), F.lit("U")).otherwise(newlines(s))).alias("open"),
    )


def token_views(lines: DataFrame, files: DataFrame) -> DataFrame:
    """views: diff_id, file_idx, added_idx, n, raw, code, strings_view, string_list, comment, in_string of added lines.

    A literal that holds U+0001, the joiner of the strings view, is cut there in string_list.
    """
    added = lines.where("type = 'add'").groupBy("diff_id", "file_idx").agg(F.array_sort(F.collect_list(F.struct("added_idx", F.col("new_no").alias("n"), F.col("text").alias("raw")))).alias("added"))
    df = added.join(files.select("diff_id", "file_idx", family(F.col("language")).alias("family")), ["diff_id", "file_idx"])
    text = F.array_join(F.col("added.raw"), "\n")
    segs = None
    for name in FAMILIES:
        found = F.regexp_extract_all(F.col("joined"), F.lit(segment_pattern(name)), F.lit(1)) if name != "prose" else F.array("joined")
        segs = F.when(F.col("family") == name, found) if segs is None else segs.when(F.col("family") == name, found)
    df = df.withColumn("joined", text).withColumn("segs", segs).drop("joined")
    streams = None
    for name in FAMILIES:
        s = _streams(name, F.col("segs"))
        streams = F.when(F.col("family") == name, s) if streams is None else streams.when(F.col("family") == name, s)
    df = df.withColumn("streams", streams).drop("segs")
    cut = lambda c: F.split(F.col(f"streams.{c}"), "\n", -1).alias(c)
    df = df.select("diff_id", "file_idx", F.explode(F.arrays_zip(F.col("added").alias("a"), cut("code"), cut("strings"), cut("comments"), cut("open"))).alias("z"))
    stripped = lambda c: F.regexp_replace(F.col(f"z.{c}"), SEP + "\\z", "")
    return df.select(
        "diff_id", "file_idx", F.col("z.a.added_idx").alias("added_idx"), F.col("z.a.n").alias("n"), F.col("z.a.raw").alias("raw"), F.col("z.code").alias("code"), stripped("strings").alias("strings_view"),
        F.when(F.col("z.strings") == "", F.array().cast("array<string>")).otherwise(F.split(stripped("strings"), SEP, -1)).alias("string_list"),
        F.replace(stripped("comments"), F.lit(SEP), F.lit(" ")).alias("comment"), F.col("z.open").contains("U").alias("in_string"),
    )
