"""Retrieval quality: per query and over a suite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(results: DataFrame) -> DataFrame:
    """precision_at_5, mrr, contamination of each query_no from its results (rank, hit)."""
    hit = F.col("hit").cast("int")
    return results.groupBy("query_no").agg(
        F.round(F.avg(hit), 6).alias("precision_at_5"), F.round(F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)), 6).alias("mrr"), (F.count(F.lit(1)) - F.sum(hit)).alias("contamination")
    )


def suite(per_query: DataFrame) -> DataFrame:
    """Means over queries and nearest-rank percentiles."""
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("precision_at_5"), 6).alias("precision_at_5"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("contamination"), 6).alias("contamination"),
        F.expr("percentile_disc(0.5) within group (order by contamination)").cast("bigint").alias("contamination_p50"), F.expr("percentile_disc(0.99) within group (order by contamination)").cast("bigint").alias("contamination_p99"),
    )
