"""Entropy of string literals: shape of a secret, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.scalars import half_up, shannon, trim

# Shapes of benign tokens, and thresholds.
BENIGN = [
    r"(?i)^(?:x{3,}|\.{3,}|<[^>]+>|\$\{[^}]+\}|%[sd]|changeme|example|placeholder|your[-_ ]?[A-Za-z0-9_]+|todo|none|null|undefined|true|false)\z",
    r"(?i)^[a-z][a-z0-9+.\-]*://", r"^[.]{0,2}/|^[A-Za-z]:\\",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z", r"^[A-Za-z]+(?:[ _-][A-Za-z]+)+\z", r"^(.)\1+\z",
]
RUN = r"[A-Za-z0-9+/_\-]{20,}={0,2}"
HASH_LENGTHS = [32, 40, 56, 64, 96, 128]


def findings(candidates: Column) -> Column:
    """array<struct<confidence, neg, entropy, value>> of the candidates that look like secrets; neg: minus the place."""
    kept = F.filter(F.transform(candidates, lambda c, i: F.struct(trim(c).alias("s"), (-i).alias("neg"))), lambda x: (F.length(x["s"]).between(20, 200)) & x["s"].rlike(r"^[A-Za-z0-9+/_\-]+={0,2}\z"))
    for p in BENIGN:
        kept = F.filter(kept, _unlike(p))
    kept = F.filter(kept, lambda x: F.size(F.array_distinct(F.split(x["s"], ""))) / F.length(x["s"]) >= 0.35)
    measured = F.transform(kept, lambda x: F.struct(
        x["s"].alias("s"), x["neg"].alias("neg"), shannon(x["s"]).alias("h"),
        (x["s"].rlike("[a-z]").cast("int") + x["s"].rlike("[A-Z]").cast("int") + x["s"].rlike("[0-9]").cast("int") + x["s"].rlike("[^A-Za-z0-9]").cast("int")).alias("classes"),
        (x["s"].rlike(r"(?i)^[0-9a-f]+\z") & F.length(x["s"]).isin(HASH_LENGTHS)).alias("hash"),
    ))
    real = F.filter(measured, lambda x: (x["h"] >= F.when(x["hash"], 3.6).otherwise(4.0)) & (x["classes"] >= 2))
    step = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0))
    hundredths = lambda x: F.least(F.lit(95), F.lit(40) + step(x["h"] >= 4.3, 20) + step(x["h"] >= 4.6, 10) + step(F.length(x["s"]) >= 32, 15) + step(x["classes"] >= 3, 15))
    return F.transform(real, lambda x: F.struct((hundredths(x) / 100).alias("confidence"), x["neg"].alias("neg"), (half_up(x["h"] * 100) / 100).alias("entropy"), x["s"].alias("value")))


def _unlike(pattern: str):
    return lambda x: ~x["s"].rlike(pattern)


def best_finding(string_list: Column) -> Column:
    """The strongest finding of a line's literals and the long runs in them, the first of equals; null without one."""
    candidates = F.flatten(F.transform(string_list, lambda s: F.concat(F.array(s), F.regexp_extract_all(s, F.lit(f"({RUN})"), F.lit(1)))))
    return F.array_max(findings(candidates))

