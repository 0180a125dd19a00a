"""The inverted index of a text column as tables: postings and document lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions.norm import words


def postings(df: DataFrame, key: str = "row_no", text: str = "text") -> DataFrame:
    """key, term, tf. Null and empty texts have none."""
    return df.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(df: DataFrame, key: str = "row_no", text: str = "text") -> DataFrame:
    return df.select(key, F.size(words(F.col(text))).alias("length"))
