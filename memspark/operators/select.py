"""Greedy selection on the short list of one query: diversity, interference, budgets. At most a few dozen rows a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MMR_LAMBDA, RIF_SIMILARITY, RIF_RATIO = 0.7, 0.85, 0.80
RELATION_HIT, RELATION_CAP = 0.03, 0.09


def _cosines(vectors) -> np.ndarray:
    rows = [np.asarray(v if v is not None else [], np.float64) for v in vectors]
    dim = max((len(v) for v in rows), default=0)
    m = np.array([v if len(v) == dim else np.zeros(dim) for v in rows]).reshape(len(rows), dim)
    n = np.linalg.norm(m, axis=1)
    m = m / np.where(n > 0, n, 1)[:, None]
    return m @ m.T


def mmr(pool: DataFrame, limit: int, weight: float = MMR_LAMBDA) -> DataFrame:
    """Of each query's pool (query_no, row_no, score, vector) ``limit`` rows by maximal marginal relevance, with place.

    The first is the best by score; then argmax of weight * score - (1 - weight) * greatest cosine to the chosen, which
    is 0 at least. Ties go by row_no. Rows without a vector resemble nothing.
    """

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "row_no"], ascending=[False, True]).reset_index(drop=True)
        sim, chosen, near = np.maximum(_cosines(g["vector"]), 0), [], np.zeros(len(g))
        left = list(range(len(g)))
        while left and len(chosen) < limit:
            gain = [weight * g.score[i] - (1 - weight) * near[i] if chosen else g.score[i] for i in left]
            i = left.pop(int(np.argmax(gain)))
            chosen.append(i)
            near = np.maximum(near, sim[i])
        return pd.DataFrame({"query_no": g.query_no[chosen], "row_no": g.row_no[chosen], "score": g.score[chosen], "place": range(1, len(chosen) + 1)})

    return pool.select("query_no", "row_no", "score", "vector").groupBy("query_no").applyInPandas(pick, "query_no bigint, row_no bigint, score double, place int")


def demote_interference(pool: DataFrame, similarity: float = RIF_SIMILARITY, ratio: float = RIF_RATIO) -> DataFrame:
    """Order of each query's pool with weak near-duplicates put behind; nothing is dropped. Pools of two stay."""

    def order(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "row_no"], ascending=[False, True]).reset_index(drop=True)
        sim, kept, behind = _cosines(g["vector"]), [], []
        for i in range(len(g)):
            weak = len(g) > 2 and any(sim[i, j] > similarity and g.score[i] < ratio * g.score[j] for j in kept)
            (behind if weak else kept).append(i)
        at = kept + behind
        return pd.DataFrame({"query_no": g.query_no[at], "row_no": g.row_no[at], "demoted": [i in behind for i in at], "place": range(1, len(at) + 1)})

    return pool.select("query_no", "row_no", "score", "vector").groupBy("query_no").applyInPandas(order, "query_no bigint, row_no bigint, demoted boolean, place int")


def relation_boost(pool: DataFrame) -> DataFrame:
    """Adds ``boosted``: the score plus 0.03 for each relation to or from another row of the pool, 0.09 at most.

    ``pool`` has query_no, row_no, id, score, targets (array of ids). Forward hits count repeats, reverse hits count
    sources once.
    """
    links = pool.select("query_no", "id", F.explode("targets").alias("target"))
    forward = links.join(pool.select("query_no", F.col("id").alias("target")).distinct(), ["query_no", "target"]).groupBy("query_no", "id").agg(F.count(F.lit(1)).alias("f"))
    reverse = links.groupBy("query_no", F.col("target")).agg(F.count_distinct("id").alias("r")).withColumnRenamed("target", "id")
    hits = F.coalesce("f", F.lit(0)) + F.coalesce("r", F.lit(0))
    out = pool.join(forward, ["query_no", "id"], "left").join(reverse, ["query_no", "id"], "left")
    return out.withColumn("boosted", F.when(hits > 0, F.least(F.lit(1.0), F.col("score") + F.least(hits * RELATION_HIT, F.lit(RELATION_CAP)))).otherwise(F.col("score"))).drop("f", "r")


def char_budget(ranked: DataFrame, most_items: int = 10, most_chars: int = 8000) -> DataFrame:
    """Of each query's list in order of ``place`` the prefix within the budget; always the first row."""
    w = Window.partitionBy("query_no").orderBy("place")
    total = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fits = ranked.withColumn("total", total).withColumn("n", F.row_number().over(w))
    over = F.max(F.when((F.col("total") > most_chars) & (F.col("n") > 1), F.lit(1)).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return fits.withColumn("over", over).where((F.col("over") == 0) & (F.col("n") <= most_items)).drop("over", "n")
