"""Ranking and lifecycle mathematics as column expressions, all JVM-side."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000.0
#: Fixed values of the lifecycle model.
HALF_LIFE_DAYS, IMPORTANCE_MODULATION = 30.0, 1.5
WEIGHTS = {"recency": 0.4, "frequency": 0.3, "intrinsic": 0.3}
BETA = {"core": 0.8, "working": 1.0, "peripheral": 1.3}
FLOOR = {"core": 0.9, "working": 0.7, "peripheral": 0.5}
RETENTION = {
    "default": {"profile": (365, 0.2), "preferences": (180, 0.3), "entities": (90, 0.5), "events": (30, 1.0), "cases": (60, 0.8), "patterns": (180, 0.3)},
    "legal": {k: (9999, 0.0) for k in ("profile", "preferences", "entities", "events", "cases", "patterns")},
    "ephemeral": {"profile": (30, 0.5), "preferences": (14, 1.0), "entities": (14, 1.5), "events": (7, 2.0), "cases": (14, 1.5), "patterns": (14, 1.0)},
}
STALE, BOOST_MIN = 0.3, 0.3
#: Fixed values of ranking.
RRF_K, LENGTH_ANCHOR, RECENCY_DAYS, RECENCY_WEIGHT, TIME_DECAY_DAYS = 60, 500, 14.0, 0.1, 60.0
REINFORCEMENT, MAX_HALF_LIFE = 0.5, 3.0


def by_name(c: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def clamp01(c: Column, fallback: Column | float = 0.0) -> Column:
    return F.when(c.isNull() | F.isnan(c), F.lit(fallback)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def similarity(cosine: Column) -> Column:
    """Score of a cosine distance d = 1 - cosine: 1 / (1 + d)."""
    return 1 / (1 + (1 - cosine))


def bm25_sigmoid(raw: Column) -> Column:
    return F.when(raw > 0, 1 / (1 + F.exp(-raw / 5))).otherwise(0.5)


def age_days(now: Column, ts: Column) -> Column:
    return (now - ts) / F.lit(DAY_MS)


def recency_boost(score: Column, now: Column, ts: Column, days: float = RECENCY_DAYS, weight: float = RECENCY_WEIGHT) -> Column:
    return clamp01(score + F.exp(-age_days(now, ts) / days) * weight)


def importance_weight(score: Column, importance: Column, base: float = 0.7) -> Column:
    return clamp01(score * (base + (1 - base) * importance))


def length_norm(score: Column, text: Column, anchor: int = LENGTH_ANCHOR) -> Column:
    factor = 1 / (1 + 0.5 * F.log2(F.greatest(F.length(text) / F.lit(anchor), F.lit(1.0))))
    return clamp01(score * factor)


def effective_half_life(days: float, accesses: Column, last: Column, now: Column, factor: float = REINFORCEMENT, most: float = MAX_HALF_LIFE) -> Column:
    """Half-life lengthened by recent accesses, at most ``most`` times."""
    since = F.greatest(F.lit(0.0), age_days(now, last))
    effective = accesses * F.pow(F.lit(2.0), -since / 30.0)
    return F.when(accesses <= 0, F.lit(days)).otherwise(F.least(days + days * factor * F.log1p(effective), F.lit(days * most)))


def time_decay(score: Column, now: Column, ts: Column, half_life: Column) -> Column:
    return clamp01(score * (0.5 + 0.5 * F.exp(-age_days(now, ts) / half_life)))


def decay_recency(now: Column, tier: Column, importance: Column, accesses: Column, last: Column, created: Column, half_life: float | Column = HALF_LIFE_DAYS) -> Column:
    """Stretched exponential of the days since last use, the half-life lengthened by importance."""
    days = F.greatest(F.lit(0.0), age_days(now, F.when(accesses > 0, last).otherwise(created)))
    rate = F.lit(math.log(2)) / (F.lit(half_life) * F.exp(IMPORTANCE_MODULATION * importance))
    return F.exp(-rate * F.pow(days, by_name(tier, BETA, 1.0)))


def decay_frequency(accesses: Column, last: Column, created: Column) -> Column:
    base = 1 - F.exp(-accesses / F.lit(5.0))
    gap = F.greatest(F.lit(1.0), age_days(last, created)) / F.greatest(accesses - 1, F.lit(1))
    return F.when(accesses <= 1, base).otherwise(base * (0.5 + 0.5 * F.exp(-gap / 30.0)))


def decay_intrinsic(importance: Column, confidence: Column, feedback: Column | float = 0.5) -> Column:
    return importance * confidence * (0.6 + 0.8 * F.lit(feedback))


def decay_composite(recency: Column, frequency: Column, intrinsic: Column) -> Column:
    return WEIGHTS["recency"] * recency + WEIGHTS["frequency"] * frequency + WEIGHTS["intrinsic"] * intrinsic


def retained_composite(composite: Column, age: Column, category: Column, tier: Column, importance: Column, frequency: Column, intrinsic: Column, preset: str, max_days: float | None = None) -> Column:
    """The composite under a retention preset: old rows near stale, young ones kept, others with another half-life."""
    least, factor = by_name(category, {k: v[0] for k, v in RETENTION[preset].items()}, -1.0), by_name(category, {k: v[1] for k, v in RETENTION[preset].items()}, 1.0)
    rate = F.lit(math.log(2)) / (HALF_LIFE_DAYS / factor * F.exp(IMPORTANCE_MODULATION * importance))
    slower = decay_composite(F.exp(-rate * F.pow(F.greatest(age, F.lit(0.0)), by_name(tier, BETA, 1.0))), frequency, intrinsic)
    out = F.when(age <= least, F.greatest(composite, F.lit(0.95))).when((factor > 0) & (factor != 1.0), slower).otherwise(composite)
    return out if max_days is None else F.when(age > max_days, F.least(composite, F.lit(0.05))).otherwise(out)


def tier_floor(composite: Column, tier: Column) -> Column:
    return F.greatest(composite, by_name(tier, FLOOR, 0.7))


def search_boost(score: Column, composite: Column) -> Column:
    return score * F.least(F.lit(1.0), F.greatest(F.lit(BOOST_MIN), BOOST_MIN + (1 - BOOST_MIN) * composite))


def tier_after(tier: Column, accesses: Column, composite: Column, importance: Column, age: Column) -> Column:
    """The tier a row moves to, or the one it has."""
    return (
        F.when((tier == "peripheral") & (accesses >= 3) & (composite >= 0.4), "working")
        .when((tier == "working") & (accesses >= 10) & (composite >= 0.7) & (importance >= 0.8), "core")
        .when((tier == "working") & ((composite < 0.15) | ((age > 60) & (accesses < 3))), "peripheral")
        .when((tier == "core") & (composite < 0.15) & (accesses < 3), "working")
        .otherwise(tier)
    )
