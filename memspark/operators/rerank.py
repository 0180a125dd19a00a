"""Reranking of short lists by a pluggable scorer, blended with the score so far."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.score import clamp01

#: A reranker: of a query and its texts, the scores of some of them by place; None if it fails.
Reranker = Callable[[str, list[str]], dict[int, float] | None]
#: Shares of the reranker's and of the old score; those of the fall back on cosines.
BLEND, FALLBACK = (0.6, 0.4), (0.7, 0.3)


def word_overlap(query: str, texts: list[str]) -> dict[int, float]:
    """A reranker without a model: the share of the query's words found in a text; texts without any are not returned."""
    import re

    words = lambda t: set(re.findall(r"[^\W_]+", (t or "").lower()))
    q = words(query)
    scores = {i: len(q & words(t)) / len(q) for i, t in enumerate(texts)} if q else {}
    return {i: s for i, s in scores.items() if s > 0}


def kept_score(score: Column, bm25: Column, returned: bool) -> Column:
    """What a row keeps of its score whatever the reranker says: strong word hits keep most."""
    b, shares = F.coalesce(bm25, F.lit(0.0)), ((0.95, 0.9, 0.5) if returned else (1.0, 0.95, 0.8))
    return score * F.when(b >= 0.75, shares[0]).when(b >= 0.6, shares[1]).otherwise(shares[2])


def rerank(pool: DataFrame, reranker: Reranker | None = word_overlap) -> DataFrame:
    """``pool`` (query_no, row_no, query, text, score, bm25, query_vector, vector) with ``reranked``.

    Rows the reranker scores get 0.6 of that and 0.4 of their score, others 0.8 of it; none falls under ``kept_score``.
    Without a reranker, or where it fails, 0.7 of the score and 0.3 of the cosine count; a missing vector has cosine 0.
    A pool is the short list of one query.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row_no")
        texts = [t or "" for t in g.text]
        try:
            found = reranker(g["query"].iloc[0] or "", texts) if reranker else None
        except Exception:  # noqa: BLE001 - whatever a reranker does, the search goes on
            found = None
        if found is None:
            q = g.query_vector.iloc[0]
            cos = [_cosine(q, v) for v in g.vector]
            return pd.DataFrame({"query_no": g.query_no, "row_no": g.row_no, "_given": cos, "_by": "cosine"})
        return pd.DataFrame({"query_no": g.query_no, "row_no": g.row_no, "_given": [found.get(i, np.nan) for i in range(len(g))], "_by": ["reranker" if i in found else "none" for i in range(len(g))]})

    given = pool.select("query_no", "row_no", "query", "text", "query_vector", "vector").groupBy("query_no").applyInPandas(run, "query_no bigint, row_no bigint, _given double, _by string")
    score, new = F.col("score"), F.col("_given")
    blended = (
        F.when(F.col("_by") == "cosine", clamp01(FALLBACK[0] * score + FALLBACK[1] * new))
        .when(F.col("_by") == "reranker", F.greatest(kept_score(score, F.col("bm25"), True), clamp01(BLEND[0] * new + BLEND[1] * score)))
        .otherwise(F.greatest(kept_score(score, F.col("bm25"), False), clamp01(0.8 * score)))
    )
    return pool.join(given, ["query_no", "row_no"]).withColumn("reranked", blended).drop("_given", "_by")


def _cosine(a, b) -> float:
    if a is None or b is None or len(a) != len(b) or not len(a):
        return 0.0
    a, b = np.asarray(a, float), np.asarray(b, float)
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / n if np.isfinite(n) and n > 0 else 0.0
