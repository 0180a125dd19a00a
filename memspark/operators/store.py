"""The store as tables: appending, patching and deleting rows as plans that give the new table.

Every operation is set-based: a batch of changes meets the table in one join on the key. ``MemoryEngine`` writes the
results by an atomic swap of directories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.ids import memory_id
from memspark.functions.norm import scope_key

#: Shortest prefix of an id that may stand for it, defaults of imported rows.
ID_PREFIX, IMPORT_IMPORTANCE = 8, 0.7


def with_ids(df: DataFrame) -> DataFrame:
    """Adds ``id`` from scope and text."""
    return df.withColumn("id", memory_id(scope_key(F.col("scope")), F.col("text")))


def new_rows(store: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Rows of the batch whose id the store lacks, the first by ``order`` of each id; the rest exist already."""
    first = batch.groupBy("id").agg(F.min(order).alias(order))
    return batch.join(first, ["id", order], "left_semi").join(store.select("id"), "id", "left_anti")


def append(store: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    return store.unionByName(new_rows(store, batch, order), allowMissingColumns=True)


def resolve_prefix(store: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (ref) with id: an exact id, or the only id with a prefix of 8 or more hexadecimal digits; else null.

    Ids are matched by their first 8 characters, an equi-join, then by the whole reference.
    """
    a = asked.select("ref").distinct().withColumn("_p", F.substring("ref", 1, ID_PREFIX)).where(F.length("ref") >= ID_PREFIX)
    s = store.select("id").where("id is not null").distinct().withColumn("_p", F.substring("id", 1, ID_PREFIX))
    hit = a.join(s, "_p").where(F.col("id").startswith(F.col("ref"))).groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return asked.join(hit.where("n = 1").select("ref", "id"), "ref", "left")


def patch(store: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """The store with ``columns`` taken from ``changes`` (one row per id) where those are not null."""
    c = changes.select("id", *[F.col(x).alias(f"_new_{x}") for x in columns])
    out = store.join(c, "id", "left")
    return out.withColumns({x: F.coalesce(f"_new_{x}", x) for x in columns}).select(*store.columns)


def patch_metadata(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store with the keys of ``changes`` (id, patch: map of JSON texts) laid over its metadata; other keys stay.

    Values keep their JSON types, as variants. Unreadable metadata counts as empty; a patch value that is no JSON
    becomes null.
    """
    old = F.coalesce(F.from_json("metadata", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    new = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key("patch", k)), F.transform_values("patch", lambda k, v: F.try_parse_json(v)))
    out = store.join(changes.select("id", "patch"), "id", "left")
    return out.withColumn("metadata", F.when(F.col("patch").isNotNull(), F.to_json(new)).otherwise(F.col("metadata"))).select(*store.columns)


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id"), "id", "left_anti")


def bulk_delete(store: DataFrame, scopes: list[str], before_ms: int | None = None) -> DataFrame:
    """The store without the rows of the scopes (none: of all) from before the time; one condition is needed."""
    if not scopes and before_ms is None:
        raise ValueError("bulk_delete needs scopes or a time")
    gone: Column = F.lit(True)
    if scopes:
        gone = gone & scope_key(F.col("scope")).isin(scopes)
    if before_ms is not None:
        gone = gone & F.coalesce(F.col("timestamp_ms") < before_ms, F.lit(False))
    return store.where(~gone)


def importable(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows to import: text of two characters or more, id not there yet; importance in 0..1, 0.7 if missing."""
    ok = batch.where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= 2).join(store.select("id").where("id is not null"), "id", "left_anti")
    return ok.withColumn("importance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("importance", F.lit(IMPORT_IMPORTANCE)))))
