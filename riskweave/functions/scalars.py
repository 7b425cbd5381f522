"""Scalar column functions with the semantics that reports depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.dialect import JS_WS

#: Ordered from least to most severe, with weights.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
WEIGHTS = {"info": 0, "low": 4, "medium": 10, "high": 22, "critical": 40}


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{JS_WS}]+|[{JS_WS}]+\\z", "")


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def truncate(c: Column, n: int) -> Column:
    """Tabs become two spaces; beyond n UTF-16 units, n - 1 characters and an ellipsis."""
    c = F.replace(c, F.lit("\t"), F.lit("  "))
    return F.when(utf16_length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def half_up(x: Column) -> Column:
    """Nearest integer, halves upward."""
    return F.floor(x + 0.5)


def round1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def number(x: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    x = x.cast("double")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def rank(sev: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), sev).cast("int") - 1


def severity_name(r: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (r + 1).cast("int"))


def weight(sev: Column) -> Column:
    out = F.lit(0)
    for k, v in WEIGHTS.items():
        out = F.when(sev == k, F.lit(v)).otherwise(out)
    return out


def capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def pascal(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "[-_]"), capital), "")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def mark_invisibles(c: Column) -> Column:
    """Invisible and direction characters as <U+XXXX>."""
    odd = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]"
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(odd), F.format_string("<U+%04X>", F.ascii(x))).otherwise(x)), "")


def indent_width(c: Column) -> Column:
    return F.length(F.replace(F.regexp_extract(c, "^[\\t ]*", 0), F.lit("\t"), F.lit("    ")))


def log2(x: Column) -> Column:
    return F.log(x) / F.log(F.lit(2.0))


def shannon(s: Column) -> Column:
    """Bits per character."""
    chars = F.split(s, "")
    share = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / F.size(chars)
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, ch: acc - share(ch) * log2(share(ch)))
