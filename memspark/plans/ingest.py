"""What becomes of a batch of new rows: stored, left out, or set against a row that is there; and what that row gets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.slots import slot
from memspark.functions.text import contradicts, is_noise
from memspark.metadata import active_at, with_smart_meta
from memspark.operators.search import vector_hits

#: Neighbours looked at and their least score, score of a duplicate, least score and number of links.
SIMILAR, LEAST, DUPLICATE, LINK, LINKS = 5, 0.1, 0.98, 0.6, 3
#: Least score of a row that a candidate is set against.
AGAINST = 0.7
DECISIONS = ("create", "merge", "skip", "support", "contextualize", "contradict", "supersede")


def understood(batch: DataFrame, now: int) -> DataFrame:
    """Rows to come with the normalised columns of stored ones (scope, memory_category, fact_key, layers)."""
    for c, kind in {"id": "string", "metadata": "string", "importance": "double", "category": "string", "scope": "string", "vector": "array<float>"}.items():
        if c not in batch.columns:
            batch = batch.withColumn(c, F.lit(None).cast(kind))
    return with_smart_meta(batch.withColumn("timestamp_ms", F.lit(now).cast("bigint")))


def similar_rows(live: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """query_no, row_no, rank, score of the nearest active rows of the same scope."""
    asked = new.select(F.col("row_no").alias("query_no"), "vector", "scope")
    return vector_hits(live, asked, SIMILAR, within="scope").where(F.col("score") >= least)


def ingest_plan(mem: DataFrame, batch: DataFrame, now: int, strategy: str = "ask") -> DataFrame:
    """row_no, action, conflict_row, link_rows of each row of ``batch`` against the stored rows ``mem``.

    noise_filtered; duplicate (a row of its scope over 0.98 alike, or an earlier row of the batch with its scope and
    text); conflict_detected, or superseded with the strategy ``supersede`` (a similar row has its fact key and another
    text: ``conflict_row``); created. Rows that go in are linked with up to three similar rows from 0.6 on. A row without
    text is noise; one without vector resembles nothing.
    """
    new = understood(batch, now)
    live = mem.where(active_at(now))
    text = F.coalesce("text", F.lit(""))
    first = new.groupBy("scope", text.alias("_text")).agg(F.min("row_no").alias("_first"))
    new = new.withColumn("_text", text).join(first, ["scope", "_text"])
    hits = similar_rows(live, new.where(~is_noise(F.col("_text"))), LEAST).join(live.select("row_no", F.col("fact_key").alias("_key"), F.coalesce("text", F.lit("")).alias("_their")), "row_no")
    hits = hits.join(new.select(F.col("row_no").alias("query_no"), "fact_key", "_text"), "query_no")
    other = (F.col("_key") == F.col("fact_key")) & (F.lower(F.trim("_their")) != F.lower(F.trim("_text")))
    linked = F.col("score").between(LINK, DUPLICATE)
    near = F.transform(F.slice(F.array_sort(F.collect_list(F.when(linked, F.struct("rank", "row_no")))), 1, LINKS), lambda x: x["row_no"])
    g = hits.groupBy("query_no").agg(F.max("score").alias("_top"), F.min_by("row_no", F.when(other, F.col("rank"))).alias("_conflict"), near.alias("_near"))
    out = new.join(g.withColumnRenamed("query_no", "row_no"), "row_no", "left")
    action = (
        F.when(is_noise(F.col("_text")), "noise_filtered")
        .when((F.col("_top") > DUPLICATE) | (F.col("_first") < F.col("row_no")), "duplicate")
        .when(F.col("_conflict").isNotNull(), "superseded" if strategy == "supersede" else "conflict_detected")
        .otherwise("created")
    )
    out = out.withColumn("action", action)
    goes_in = F.col("action").isin("created", "superseded")
    return out.select("row_no", "action", F.when(F.col("action").isin("superseded", "conflict_detected"), F.col("_conflict")).alias("conflict_row"), F.when(goes_in, F.coalesce("_near", F.array().cast("array<bigint>"))).otherwise(F.array().cast("array<bigint>")).alias("link_rows"))


#: Importance from which a new row lifts others, below which they are lifted, by how much and up to where;
#: least score, least age in ms, most rows lifted, and the importance from which a peripheral row is a working one.
LIFTS, LIFTED, BY, UP_TO = 0.8, 0.6, 0.15, 0.75
LIFT_SCORE, LIFT_AGE, LIFT_ROWS, LIFT_POOL, WORKING = 0.72, 86_400_000, 5, 20, 0.5


def lifts(mem: DataFrame, new: DataFrame, now: int, within: str | None = None) -> DataFrame:
    """query_no, row_no, new_importance, new_tier of stored rows that important ``new`` ones (query_no, vector, importance)
    make more important: the five most alike of those a day old or older and not important yet."""
    hits = vector_hits(mem, new.where(F.col("importance") >= LIFTS), LIFT_POOL, within=within).where(F.col("score") >= LIFT_SCORE)
    hits = hits.join(mem.select("row_no", "importance", "tier", "timestamp_ms"), "row_no").where((F.col("importance") < LIFTED) & (F.lit(now) - F.col("timestamp_ms") >= LIFT_AGE))
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_no").orderBy("rank"))).where(F.col("n") <= LIFT_ROWS)
    value = F.least(F.lit(UP_TO), F.col("importance") + BY)
    return best.select("query_no", "row_no", value.alias("new_importance"), F.when((F.col("tier") == "peripheral") & (value >= WORKING), "working").otherwise(F.col("tier")).alias("new_tier"))


# -- decisions on candidates -------------------------------------------------------------------------------------------
#: One candidate with its similar rows (score, same_key, same_category, opposed, same_text; best first): the decision and
#: the place of the row it is set against.
Decider = Callable[[str, pd.DataFrame], tuple[str, int | None]]


def by_rule(category: str, similar: pd.DataFrame) -> tuple[str, int | None]:
    """The decision without a model. The profile takes everything in; then texts that say the same are left out, opposed
    ones and new values of a fact key are told apart, and of the rest the closest of its kind decides."""
    if category == "profile":
        return ("merge", 0)
    for i, r in enumerate(similar.itertuples()):
        if r.same_text:
            return ("skip", i)
        if r.opposed:
            return ("contradict", i)
        if r.same_key:
            return ("supersede", i)
    best = similar.iloc[0]
    if best.same_category:
        return ("support", 0) if best.score >= 0.95 else ("merge", 0) if best.score >= 0.82 else ("create", None)
    return ("contextualize", 0) if best.score >= 0.82 else ("create", None)


def decide(mem: DataFrame, batch: DataFrame, now: int, decider: Decider = by_rule) -> DataFrame:
    """row_no, decision, target_row of each candidate against up to five active rows of its scope from 0.7 on.

    One of ``DECISIONS``. Without such rows a candidate is created; a preference for an item of a brand too, where all of
    them are preferences for other items of that brand. Otherwise ``decider`` decides. Null texts count as empty.
    """
    new = understood(batch, now)
    live = mem.where(active_at(now)).withColumn("text", F.coalesce("text", F.lit("")))
    ours = new.select(F.col("row_no").alias("query_no"), F.coalesce("text", F.lit("")).alias("mine"), F.col("memory_category").alias("kind"), F.col("fact_key").alias("my_key"))
    pairs = similar_rows(live, new, AGAINST).join(live.select("row_no", "text", "memory_category", "fact_key"), "row_no").join(ours, "query_no")
    plain = lambda c: F.lower(F.trim(c))
    pairs = pairs.withColumns({"s_mine": slot(F.col("mine")), "s_their": slot(F.col("text"))})
    flag: Callable[[Column], Column] = lambda c: F.coalesce(c, F.lit(False))
    pairs = pairs.select(
        "query_no", "row_no", "rank", "score", "kind",
        flag((F.col("my_key") == F.col("fact_key")) & (plain("mine") != plain("text"))).alias("same_key"),
        flag(F.col("kind") == F.col("memory_category")).alias("same_category"),
        flag(contradicts(F.col("mine"), F.col("text"))).alias("opposed"),
        flag(plain("mine") == plain("text")).alias("same_text"),
        flag((F.col("kind") == "preferences") & (F.col("s_mine.brand") == F.col("s_their.brand")) & (F.col("s_mine.item") != F.col("s_their.item"))).alias("other_item"),
    )

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank").reset_index(drop=True)
        what, at = ("create", None) if g.other_item.all() else decider(g.kind.iloc[0], g)
        if what not in DECISIONS:
            what, at = "create", None
        return pd.DataFrame({"query_no": [g.query_no.iloc[0]], "decision": [what], "target_row": pd.array([None if at is None else g.row_no.iloc[at]], "Int64")})

    decided = pairs.groupBy("query_no").applyInPandas(run, "query_no bigint, decision string, target_row bigint")
    out = new.select("row_no").join(decided.withColumnRenamed("query_no", "row_no"), "row_no", "left")
    return out.select("row_no", F.coalesce("decision", F.lit("create")).alias("decision"), "target_row")


def changes(decided: DataFrame, now: int) -> DataFrame:
    """What the decisions change in stored rows: target_row, field, value, by_row. Stored rows that are set against
    several candidates get a change from each."""
    d = F.col("decision")
    row = lambda field, value: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"))
    by = F.col("row_no").cast("string")
    made = (
        F.when(d == "supersede", F.array(row("invalidated_at", F.lit(now)), row("superseded_by", by)))
        .when(d == "support", F.array(row("support_info.confirmations", F.lit("+1"))))
        .when(d == "contradict", F.array(row("support_info.contradictions", F.lit("+1")), row("relations.contradicts", by)))
        .when(d == "contextualize", F.array(row("relations.context_of", by)))
        .when(d == "merge", F.array(row("l2_content", by)))
    )
    return decided.where(made.isNotNull() & F.col("target_row").isNotNull()).select("target_row", F.inline(made), F.col("row_no").alias("by_row"))
