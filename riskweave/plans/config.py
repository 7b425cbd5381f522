"""Configuration and gate: normalisation on the driver, verdicts as columns."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import SEVERITIES, severity_name


def normalize_gate(gate) -> dict | None:
    if not isinstance(gate, dict):
        return None
    out = {}
    if gate.get("failOn") in SEVERITIES:
        out["failOn"] = gate["failOn"]
    score = gate.get("maxScore")
    if isinstance(score, (int, float)) and not isinstance(score, bool) and math.isfinite(score):
        out["maxScore"] = max(0, min(100, math.floor(score + 0.5)))
    return out or None


@dataclass(frozen=True)
class Config:
    disabled: dict[str, bool] = field(default_factory=dict)
    severity: dict[str, str] = field(default_factory=dict)
    gate: dict | None = None

    def enabled(self, rule_id: str) -> bool:
        return not self.disabled.get(rule_id)

    def to_json(self) -> str:
        out = {"disabled": self.disabled, "severity": self.severity, "version": 1}
        return json.dumps(out | ({"gate": self.gate} if self.gate else {}), indent=2)


def normalize(raw) -> Config:
    """Unknown severities go, values of `disabled` become booleans, ids are kept as they are."""
    raw = raw if isinstance(raw, dict) else {}
    part = lambda k: raw[k] if isinstance(raw.get(k), dict) else {}
    return Config({k: bool(v) for k, v in part("disabled").items()}, {k: v for k, v in part("severity").items() if v in SEVERITIES}, normalize_gate(raw.get("gate")))


def load(path: str | Path) -> Config:
    return normalize(json.loads(Path(path).read_text(encoding="utf-8")))


def find_up(start: str | Path, name: str = ".riskweave.json", most: int = 50) -> Path | None:
    """The nearest configuration file in start or its parents."""
    at = Path(start).resolve()
    for folder in [at, *at.parents][:most]:
        if (folder / name).is_file():
            return folder / name
    return None


def gate_reasons(score: Column, worst_rank: Column, gate: dict | None) -> Column:
    """array<string>: why the gate fails; empty if it passes. worst_rank is -1 or null without signals."""
    gate = normalize_gate(gate) or {}
    checks = []
    if "maxScore" in gate:
        checks.append(F.when(score > gate["maxScore"], F.concat(F.lit("score "), score.cast("string"), F.lit(f" exceeds maxScore {gate['maxScore']}"))))
    if "failOn" in gate:
        floor = SEVERITIES.index(gate["failOn"])
        checks.append(F.when(worst_rank >= floor, F.concat(severity_name(worst_rank), F.lit(f"-severity signal at or above failOn threshold {gate['failOn']}"))))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def evaluate_gate(scores: DataFrame, gate: dict | None) -> DataFrame:
    """gate: diff_id, failed, reasons. scores needs diff_id, score, worst_rank."""
    reasons = gate_reasons(F.col("score"), F.col("worst_rank"), gate)
    return scores.select("diff_id", (F.size(reasons) > 0).alias("failed"), reasons.alias("reasons"))
