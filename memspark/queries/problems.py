"""Queries of the general problems: histories, drifting schemas, nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators.drift import schema_changes, unified_table
from memspark.operators.history import fact_history
from memspark.operators.nested import FIELDS, child_table, shred
from memspark.session import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return fact_history(read_table(spark, d, "fact_updates")).select("scope", "fact_key", "valid_from", "valid_to")


def p1_history(spark: SparkSession, d: str) -> DataFrame:
    return fact_history(read_table(spark, d, "fact_updates"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = shred(read_table(spark, d, "memories"), "metadata", "row_no")
    return nodes.select("row_no", "child_path", "parent_pos", "child_pos", "link_value")


def p5_relations(spark: SparkSession, d: str) -> DataFrame:
    return child_table(shred(read_table(spark, d, "memories"), "metadata", "row_no"), "relations").select("row_no", F.col("child_pos"), "link_value")


def p5_table(path: str) -> Callable[[SparkSession, str], DataFrame]:
    """Query of the child table of one schema path, with all fields of its elements."""
    return lambda spark, d: child_table(shred(read_table(spark, d, "memories"), "metadata", "row_no"), path)


P5_TABLES = {f"p5_table_{path.split('.')[-1]}": p5_table(path) for path in FIELDS}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(read_table(spark, d, "raw_exports")).select("file_no", "change_kind", "field_path", "old_path")


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    return unified_table(read_table(spark, d, "raw_exports"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_history, p4_found, p4_table, p5_found, p5_relations)} | P5_TABLES
