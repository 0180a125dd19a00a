"""What a turn of a conversation gets from memory by itself: which rows, how much of each, and what is noted on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import inline

#: Rows and characters of one turn, characters of one row, turns a row stays away, bad recalls to suppress.
ITEMS, CHARS, EACH, TURNS, BAD = 3, 600, 180, 8, 3


def governed(pool: DataFrame, mem: DataFrame, turn: int) -> DataFrame:
    """Rows of ``pool`` that are confirmed, in no archive or reflection layer, and not suppressed at ``turn``."""
    until = F.coalesce(F.get_json_object("metadata", "$.suppressed_until_turn").try_cast("double"), F.lit(0.0))
    ok = mem.where((F.col("state") == "confirmed") & ~F.col("memory_layer").isin("archive", "reflection") & ~((until > 0) & (F.lit(turn) <= until)))
    return pool.join(ok.select("row_no"), "row_no", "left_semi")


def inject(pool: DataFrame, mem: DataFrame, turn: int = 0, shown: DataFrame | None = None, items: int = ITEMS, chars: int = CHARS) -> DataFrame:
    """query_no, row_no, place, line, taken: of each query's pool (query_no, row_no, place) the rows that go into its turn.

    ``shown`` (row_no, turn) tells when a row was last given; it stays away for ``TURNS`` turns. The rows that are left
    give their abstract, one line of at most ``EACH`` characters, in order until ``items`` rows or ``chars`` characters
    are reached; the last may be cut. Empty lines are left out. A pool is the short list of one query.
    """
    if shown is not None:
        recent = shown.groupBy("row_no").agg(F.max("turn").alias("turn")).where(F.lit(turn) - F.col("turn") < TURNS)
        pool = pool.join(recent.select("row_no"), "row_no", "left_anti")
    rows = governed(pool, mem, turn).join(mem.select("row_no", inline(F.col("l0"), EACH).alias("line")), "row_no").where("line != ''")
    w = Window.partitionBy("query_no").orderBy("place", "row_no")
    before = F.coalesce(F.sum(F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"_n": F.row_number().over(w), "_before": before}).where((F.col("_n") <= items) & (F.col("_before") < chars))
    taken = F.least(F.length("line"), chars - F.col("_before")).cast("bigint")
    return rows.select("query_no", "row_no", "place", F.expr(f"substring(line, 1, cast(least(length(line), {chars} - _before) as int))").alias("line"), taken.alias("taken"))


def noted(given: DataFrame, mem: DataFrame, now: int, turn: int) -> DataFrame:
    """row_no and its new injected_count, last_injected_at, bad_recall_count, suppressed_until_turn after being given.

    A row that was given before and not confirmed in use since counts one bad recall more; from ``BAD`` on it stays away
    for ``TURNS`` turns. A row given to several queries of the turn is noted once.
    """
    num = lambda k: F.coalesce(F.get_json_object("metadata", f"$.{k}").try_cast("double"), F.lit(0.0))
    m = mem.join(given.select("row_no").distinct(), "row_no", "left_semi")
    stale = (num("last_injected_at") > 0) & (num("last_confirmed_use_at") < num("last_injected_at"))
    bad = F.col("bad_recall_count") + stale.cast("int")
    until = F.when(bad >= BAD, F.greatest(num("suppressed_until_turn"), F.lit(float(turn + TURNS)))).otherwise(num("suppressed_until_turn"))
    return m.select("row_no", (num("injected_count") + 1).cast("bigint").alias("injected_count"), F.lit(now).cast("bigint").alias("last_injected_at"), bad.cast("bigint").alias("bad_recall_count"), until.cast("bigint").alias("suppressed_until_turn"))
