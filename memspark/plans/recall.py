"""Ranked recall: channels, fusion, length and lifecycle stages, thresholds, diversity. A table of queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import score as S
from memspark.functions.text import is_noise
from memspark.metadata import active_at
from memspark.operators.search import CHANNELS, VECTOR_ONLY, bm25_hits, fuse, vector_hits
from memspark.operators.select import mmr
from memspark.session import checkpoint

LAYERS = {"vector": "vector", "l0": "vector_l0", "l1": "vector_l1", "l2": "vector_l2"}


@dataclass(frozen=True)
class RecallConfig:
    """Settings of a recall; ``now`` is epoch milliseconds. Thresholds of 0 keep everything."""

    now: int
    limit: int = 10
    pool: int = 20
    min_score: float = 0.0
    hard_min_score: float = 0.0
    filter_noise: bool = True
    weights: dict[str, float] = field(default_factory=lambda: dict(CHANNELS))


def with_decay(df: DataFrame, now: int) -> DataFrame:
    """Adds ``composite``, the lifecycle score with its tier's floor."""
    c, at = F.col, F.lit(now)
    r = S.decay_recency(at, c("tier"), c("importance"), c("access_count"), c("last_accessed_at"), c("timestamp_ms"))
    f = S.decay_frequency(c("access_count"), c("last_accessed_at"), c("timestamp_ms"))
    return df.withColumn("composite", S.tier_floor(S.decay_composite(r, f, S.decay_intrinsic(c("importance"), c("confidence"))), c("tier")))


def ranked(hits: DataFrame, mem: DataFrame, cfg: RecallConfig) -> DataFrame:
    """Stages after fusion, each kept as a column: fused, length_norm, decayed; rows under a threshold are gone."""
    fused = fuse(hits, cfg.weights).where(F.col("fused") >= cfg.min_score)
    keep = ["row_no", "text", "importance", "confidence", "tier", "access_count", "last_accessed_at", "timestamp_ms", "memory_category"]
    out = fused.join(mem.select(*keep), "row_no").withColumn("length_norm", S.length_norm(F.col("fused"), F.coalesce("text", F.lit(""))))
    out = with_decay(out.where(F.col("length_norm") >= cfg.hard_min_score), cfg.now).withColumn("decayed", S.clamp01(S.search_boost(F.col("length_norm"), F.col("composite"))))
    return out.where(~is_noise(F.coalesce("text", F.lit("")))) if cfg.filter_noise else out


def top(df: DataFrame, limit: int, by: str = "decayed") -> DataFrame:
    """Of each query the ``limit`` best by the rounded score; the pools are short lists."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.round(by, 9)).alias("s"), "row_no"))), 1, limit)
    picked = df.groupBy("query_no").agg(best.alias("b")).select("query_no", F.posexplode("b").alias("p", "e")).select("query_no", F.col("e.row_no").alias("row_no"), (F.col("p") + 1).alias("place"))
    return df.join(picked, ["query_no", "row_no"])


def hybrid(mem: DataFrame, queries: DataFrame, cfg: RecallConfig) -> DataFrame:
    """The best ``limit`` rows of each query over four vector channels and BM25, among active rows."""
    live = mem.where(active_at(cfg.now))
    hits = vector_hits(live, queries, cfg.pool, LAYERS).unionByName(bm25_hits(live, queries, cfg.pool))
    return top(ranked(checkpoint(hits), mem, cfg), cfg.limit)


def vector_only(mem: DataFrame, queries: DataFrame, cfg: RecallConfig) -> DataFrame:
    hits = vector_hits(mem.where(active_at(cfg.now)), queries, cfg.pool, LAYERS)
    cfg = RecallConfig(cfg.now, cfg.limit, cfg.pool, cfg.min_score, cfg.hard_min_score, cfg.filter_noise, dict(VECTOR_ONLY))
    return top(ranked(checkpoint(hits), mem, cfg), cfg.limit)


def bm25_only(mem: DataFrame, queries: DataFrame, cfg: RecallConfig) -> DataFrame:
    return top(ranked(checkpoint(bm25_hits(mem.where(active_at(cfg.now)), queries, cfg.pool)), mem, cfg), cfg.limit)


def diverse(mem: DataFrame, queries: DataFrame, cfg: RecallConfig) -> DataFrame:
    """Hybrid recall of twice the limit, cut to the limit by maximal marginal relevance."""
    wide = RecallConfig(cfg.now, 2 * cfg.limit, cfg.pool, cfg.min_score, cfg.hard_min_score, cfg.filter_noise, cfg.weights)
    pool = hybrid(mem, queries, wide).select("query_no", "row_no", F.col("decayed").alias("score"))
    return mmr(pool.join(mem.select("row_no", "vector"), "row_no"), cfg.limit)
