"""The core's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.queries import analytics, extra, graph, maintenance, more, pipelines, problems, problems_sql, retrieval, single  # noqa: F401
from memspark.queries.base import QUERIES, SQL


def queries() -> dict:
    return QUERIES | problems.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | problems_sql.oracle_sql()


def entry(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["plan_p02_hybrid"](spark, d)
