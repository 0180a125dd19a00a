"""Admission of candidates: support in the conversation, novelty, recency, prior of the kind, and the decision."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions.score import by_name

#: Weights, priors, thresholds and half-lives of the presets.
PRESETS = {
    "balanced": {"weights": (0.1, 0.1, 0.1, 0.1, 0.6), "priors": {"profile": 0.95, "preferences": 0.9, "entities": 0.75, "events": 0.45, "cases": 0.8, "patterns": 0.85}, "reject": 0.45, "admit": 0.6, "pool": 8, "days": 14.0},
    "conservative": {"weights": (0.16, 0.16, 0.18, 0.08, 0.42), "priors": {"profile": 0.98, "preferences": 0.94, "entities": 0.78, "events": 0.28, "cases": 0.78, "patterns": 0.8}, "reject": 0.52, "admit": 0.68, "pool": 10, "days": 10.0},
    "high-recall": {"weights": (0.08, 0.1, 0.08, 0.14, 0.6), "priors": {"profile": 0.96, "preferences": 0.92, "entities": 0.8, "events": 0.58, "cases": 0.84, "patterns": 0.88}, "reject": 0.34, "admit": 0.52, "pool": 6, "days": 21.0},
}
UTILITY_UNKNOWN, MATCHED = 0.5, 0.55
_TOKEN = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_㐀-䶿一-鿿豈-﫿]+")


def tokens(text: str | None) -> list[str]:
    """Han characters one by one, other letters and digits in runs."""
    return _TOKEN.findall((text or "").lower().strip())


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one numpy row at a time."""
    if not a or not b:
        return 0
    codes = {t: i for i, t in enumerate(dict.fromkeys(b))}
    y = np.array([codes[t] for t in b])
    row = np.zeros(len(b) + 1, np.int32)
    for t in a:
        hit = np.concatenate([[0], row[:-1] + (y == codes.get(t, -1))])
        row = np.maximum.accumulate(np.maximum(row, hit))
    return int(row[-1])


def overlap_f1(a: list[str], b: list[str]) -> float:
    n = lcs(a, b)
    return 2 * n / (len(a) + len(b)) if n else 0.0


def support_spans(text: str | None) -> list[str]:
    """Lines, and their sentences of four characters or more."""
    out: dict[str, None] = {}
    for line in re.split(r"\n+", text or ""):
        if line.strip():
            out.setdefault(line.strip())
            for s in re.split(r"[。！？!?]+", line.strip()):
                if len(s.strip()) >= 4:
                    out.setdefault(s.strip())
    return list(out)


def support(candidate: str | None, conversation: str | None) -> float:
    """0.7 of the best span's F1, 0.3 of the share of words found, less 0.25 of the share not found; within 0..1."""
    c = tokens(candidate)
    if not c:
        return 0.0
    best = max((overlap_f1(c, tokens(s)) for s in support_spans(conversation)), default=0.0)
    there = set(tokens(conversation))
    covered = len(set(c) & there) / len(set(c))
    return min(1.0, max(0.0, 0.7 * best + 0.3 * covered - 0.25 * (1 - covered)))


def support_column(candidate: Column, conversation: Column) -> Column:
    """``support`` of two text columns, in Arrow batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([support(x, y) for x, y in zip(a, b)], dtype="float64")

    return run(candidate, conversation)


def admission_score(utility: Column, confidence: Column, novelty: Column, recency: Column, category: Column, preset: str = "balanced") -> Column:
    p = PRESETS[preset]
    u, c, n, r, t = p["weights"]
    return u * utility + c * confidence + n * novelty + r * recency + t * by_name(category, p["priors"], 0.5)


def admission_decision(score: Column, most_similar: Column, preset: str = "balanced") -> Column:
    p = PRESETS[preset]
    return F.when(score < p["reject"], "reject").when((score >= p["admit"]) & (most_similar < MATCHED), "add").otherwise("update_or_merge")


def recency_gap(days: Column, half_life: float) -> Column:
    return F.when(days.isNull(), 1.0).otherwise(1 - F.exp(-F.log(F.lit(2.0)) / half_life * F.greatest(days, F.lit(0.0))))
