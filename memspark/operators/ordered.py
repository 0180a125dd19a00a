"""Global order without one-task windows: dense positions over a range-partitioned sort.

``dense_position`` sorts by range partitioning, freezes the partitions in the shared checkpoint folder and turns
(partition, offset in it) into a gap-free position. Neighbours are then found by an equi-join on ``position + 1``, so
a key that holds a third of all rows is spread over the same number of tasks as any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.session import checkpoint, shuffle_partitions


def dense_position(df: DataFrame, keys: list[str], name: str = "pos") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in the order of ``keys`` (which should be unique; ties fall in any order).

    Empty input gives an empty result. Only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    ranged = checkpoint(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), 33)
    sizes = {r["_p"]: r["_n"] for r in ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).collect()}
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    base = F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets or [0]]), part.cast("int") + 1)
    in_part = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn(name, base + in_part).drop("_mid")


def prefix_sum(df: DataFrame, group: str, order: list[str], value: str, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``group`` that come before in ``order``.

    Distributed: range partitions are summed as streams, then each gets the total of its group in the partitions
    before it. ``group`` and ``order`` should fix the order; null values count as 0. At most one total per partition
    and group is gathered, and groups share a partition only where they are small.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = df.sparkSession
    n = shuffle_partitions(spark)
    ranged = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_pid", F.spark_partition_id())
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)

    def run(batches):
        at, total = object(), 0
        for b in batches:
            out, vals = [], pc.fill_null(b.column(value), 0).to_pylist()
            for g, v in zip(b.column(group).to_pylist(), vals):
                if g != at:
                    at, total = g, 0
                out.append(total)
                total += v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "_run"])

    summed = checkpoint(ranged.mapInArrow(run, f"{fields}, _run bigint"))
    totals = summed.groupBy(group, "_pid").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_t"))
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(group, "_pid", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    # at most partitions + groups rows, as groups are ranges
    return summed.join(F.broadcast(base) if base.count() <= 100_000 else base, [group, "_pid"]).withColumn(name, (F.col("_run") + F.col("_base")).cast("bigint")).drop("_run", "_base", "_pid")


def place_in_group(df: DataFrame, group: list[str], order: list[str], name: str = "place", keep: str | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3, ... within its group in the order given, as ``row_number`` would, but with the
    rows of a large group spread over tasks. ``keep`` names the global position, if it is wanted too.

    ``group`` and ``order`` should fix the order. Null keys form groups like others.
    """
    placed = dense_position(df, [*group, *order], "_pos")
    keys = [f"_g{i}" for i in range(len(group))]
    first = placed.groupBy(*group).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")).select(*[F.to_json(F.struct(F.col(g).alias("v"))).alias(k) for g, k in zip(group, keys)], "_first", "_n")
    from memspark.operators.skew import join_groups

    out = join_groups(placed.withColumns({k: F.to_json(F.struct(F.col(g).alias("v"))) for g, k in zip(group, keys)}), first, keys, "_n")
    out = out.withColumn(name, F.col("_pos") - F.col("_first") + 1)
    return (out if keep is None else out.withColumn(keep, F.col("_pos"))).drop("_pos", "_first", "_n", *keys)


def with_neighbour(df: DataFrame, group: list[str], order: list[str], columns: dict[str, str], step: int = 1) -> DataFrame:
    """``df`` with columns of the row ``step`` places on in its group (back if negative), null where there is none.

    ``columns`` maps columns to the names that the neighbour's values get.
    """
    placed = dense_position(df, [*group, *order], "_pos")
    other = placed.select((F.col("_pos") - step).alias("_pos"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[F.col(c).alias(n) for c, n in columns.items()])
    out = placed.join(other, "_pos", "left")
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return out.withColumns({n: F.when(same, F.col(n)) for n in columns.values()}).drop("_pos", *[f"_g{i}" for i in range(len(group))])
