"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so there are at most ``1 / HOT_SHARE`` hot keys to broadcast.
HOT_SHARE = 0.001
#: Below this many rows no key is worth a path of its own.
HOT_LEAST = 50_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int | None = None) -> DataFrame:
    """``rows`` inner-joined with ``groups`` (one row per key, ``n`` its number of rows).

    Groups with ``HOT_SHARE`` of all rows or more, at most ``1 / HOT_SHARE`` of them, are broadcast, so their rows stay
    where they are; the rest is an ordinary shuffled join. Null keys join nothing.
    """
    total = groups.agg(F.sum(n)).first()[0] if total is None else total
    least = max(HOT_LEAST, int((total or 0) * HOT_SHARE))
    if (total or 0) < least:
        return rows.join(groups, keys)
    hot = F.broadcast(groups.where(F.col(n) >= least))
    cold = groups.where(F.col(n) < least)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(groups.where(F.col(n) >= least).select(*keys)), keys, "left_anti").join(cold, keys))


#: Rows up to which a table of keys is broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have no more than ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
