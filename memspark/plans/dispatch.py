"""One call for all kinds of recall: tags go to words only, other queries to vectors and words; time and topic come after.

Also the search in two rounds, where what the first round's texts name is searched with the query again.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.embed import Embedder, embed_column, hash_embedder
from memspark.functions.temporal import parse_temporal
from memspark.metadata import active_at
from memspark.operators.search import bm25_hits, vector_hits
from memspark.plans.recall import RecallConfig, bm25_only, hybrid, top, vector_only
from memspark.session import checkpoint

#: What a tag begins with; the most rows of a recall; sizes of the two rounds.
TAGS = ("proj", "env", "team", "scope")
MOST = 20
ROUND_ONE, ROUND_TWO, ENTITIES, LEAST = 10, 5, 3, 0.25
#: Words that open sentences and are no entity.
OPENERS = frozenset("the a an is are was were be been have has had do does did will would could should may might can this that these those i you he she it we they my your his her its our their what which who when where why how not no and or but if then so for from with about into in on at to of by as user also just yes true false null".split())


def tags_of(c: Column, prefixes: tuple[str, ...] = TAGS) -> Column:
    """Tags of a query, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?i)((?:{'|'.join(prefixes)}):[\w-]+)"), 1), lambda t: F.lower(t))


def query_kind(c: Column) -> Column:
    """temporal, question, lookup or general."""
    q = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (
        F.when(q.rlike(r"\b(when|date|time|ago|yesterday|last week|last month|before|after|during)\b"), "temporal")
        .when(q.rlike(r"^(what|who|where|why|how|which|did|does|is|are|was|were|can|could)\b") | q.endswith("?"), "question")
        .when(F.size(F.split(q, r"\s+")) <= 3, "lookup")
        .otherwise("general")
    )


def for_kind(cfg: RecallConfig, kind: str) -> RecallConfig:
    """Short lookups weigh words more and the main vector less."""
    if kind != "lookup":
        return cfg
    w = cfg.weights
    return replace(cfg, weights=w | {"vector": max(w["vector"] - 0.15, 0.1), "bm25": min(w["bm25"] + 0.15, 0.9)})


def retrieve(mem: DataFrame, queries: DataFrame, cfg: RecallConfig, mode: str = "hybrid", topic: str | None = None, prefixes: tuple[str, ...] = TAGS) -> DataFrame:
    """Ranked rows of ``queries`` (query_no, text, vector): query_no, row_no, place, decayed, kind and the rows' columns.

    Queries with tags are answered by words alone, from texts that hold every tag; the others by ``mode``. A time in a
    query keeps rows of that time, ``topic`` rows with that tag. Both come after the ranking, so a query may get fewer
    rows than ``limit``, which is 1 to 20. A query without text or without hits has no rows.
    """
    cfg = replace(cfg, limit=max(1, min(MOST, cfg.limit)), pool=max(cfg.pool, 2 * max(1, min(MOST, cfg.limit))))
    now = datetime.fromtimestamp(cfg.now / 1000, UTC).replace(tzinfo=None)

    @F.pandas_udf("after_ms long, before_ms long, cleaned string")
    def understood(texts: pd.Series) -> pd.DataFrame:
        ms = lambda t: None if t is None else int((t - datetime(1970, 1, 1)).total_seconds() * 1000)
        rows = [parse_temporal(t or "", now) for t in texts]
        return pd.DataFrame({"after_ms": pd.array([ms(a) for a, _, _ in rows], "Int64"), "before_ms": pd.array([ms(b) for _, b, _ in rows], "Int64"), "cleaned": [c for _, _, c in rows]})

    asked = queries.select("query_no", "text", "vector").withColumn("_t", understood(F.coalesce("text", F.lit(""))))
    asked = asked.select("query_no", "vector", F.col("_t.after_ms"), F.col("_t.before_ms"), F.col("_t.cleaned").alias("text"))
    asked = checkpoint(asked.withColumns({"tags": tags_of(F.col("text"), prefixes), "kind": query_kind(F.col("text"))}))
    tagged, plain = asked.where(F.size("tags") > 0), asked.where(F.size("tags") == 0)
    # each kind has weights of its own, so it is a run of its own; kinds nobody asks cost nothing
    there = {r["kind"]: r["n"] for r in plain.groupBy(F.when(F.col("kind") == "lookup", "lookup").otherwise("general").alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    run, parts = {"hybrid": hybrid, "vector": vector_only, "bm25": bm25_only}[mode], []
    for kind in sorted(there):
        mine = plain.where((F.col("kind") == "lookup") == F.lit(kind == "lookup"))
        parts.append(run(mem, mine.select("query_no", "text", "vector"), for_kind(cfg, kind)))
    if not tagged.isEmpty():
        wide = bm25_only(mem, tagged.select("query_no", "text", "vector"), replace(cfg, limit=cfg.pool))
        holds = F.forall("tags", lambda t: F.contains(F.lower(F.coalesce("text", F.lit(""))), t))
        found = wide.join(tagged.select("query_no", "tags"), "query_no").where(holds).drop("tags", "place")
        parts.append(top(found, cfg.limit))
    if not parts:
        parts = [bm25_only(mem.where("false"), plain.select("query_no", "text", "vector"), cfg)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.join(asked.select("query_no", "after_ms", "before_ms", "kind"), "query_no")
    in_time = (F.col("after_ms").isNull() | (F.col("timestamp_ms") >= F.col("after_ms"))) & (F.col("before_ms").isNull() | (F.col("timestamp_ms") < F.col("before_ms")))
    out = out.where(in_time).drop("after_ms", "before_ms")
    if topic is not None:
        out = out.join(mem.where(F.lower("topic_tag") == topic.lower()).select("row_no"), "row_no", "left_semi")
    return out


# -- two rounds --------------------------------------------------------------------------------------------------------
def entities_in(text: Column) -> Column:
    """What a text names: capitalised phrases, quoted terms, paths, addresses on the web, runs of Chinese characters."""
    t = F.coalesce(text, F.lit(""))
    named = lambda p: F.regexp_extract_all(t, F.lit(p), 1)
    openers = F.array(*[F.lit(w) for w in sorted(OPENERS)])
    words = F.filter(F.transform(F.concat(named(r"\b([A-Z][a-zA-Z0-9]*(?:[\s-][A-Z][a-zA-Z0-9]*)*)\b"), named("[\"'`]([^\"'`]{2,40})[\"'`]")), F.trim), lambda e: (F.length(e) >= 2) & ~F.array_contains(openers, F.lower(e)))
    return F.concat(words, named(r"((?:\.?/[\w.-]+){2,})"), named(r"(https?://[^\s)>\"']+)"), named(r"([一-鿿]{2,8})"))


def _round(mem: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """query_no, row_no, score: the best of vectors (from ``least``) and words, each row with its higher score."""
    v = vector_hits(mem, queries, k).where(F.col("score") >= least)
    b = bm25_hits(mem, queries, k)
    return v.unionByName(b).groupBy("query_no", "row_no").agg(F.max("score").alias("score"))


def two_rounds(mem: DataFrame, queries: DataFrame, now: int, embedder: Embedder | None = None, entities: int = ENTITIES) -> DataFrame:
    """query_no, row_no, score, source (round1, round2, both) among active rows.

    Round one gives each query (query_no, text, vector) its ten best rows. The entities their texts name most often that
    the query does not hold, three at most, longer ones and then by letters on ties, are each searched together with the
    query. A row has its higher score of both rounds.
    """
    live = checkpoint(mem.where(active_at(now)).select("row_no", "text", "vector"))
    q = checkpoint(queries.select("query_no", F.coalesce("text", F.lit("")).alias("text"), "vector"))
    best = Window.partitionBy("query_no").orderBy(F.desc(F.round("score", 9)), "row_no")
    one = checkpoint(_round(live, q, ROUND_ONE, LEAST).withColumn("n", F.row_number().over(best)).where(F.col("n") <= ROUND_ONE).drop("n"))
    named = one.join(live.select("row_no", "text"), "row_no").select("query_no", F.explode(entities_in(F.col("text"))).alias("entity")).groupBy("query_no", "entity").agg(F.count(F.lit(1)).alias("n"))
    novel = named.join(q.select("query_no", "text"), "query_no").where(~F.contains(F.lower("text"), F.lower("entity")))
    order = Window.partitionBy("query_no").orderBy(F.desc("n"), F.desc(F.length("entity")), "entity")
    again = novel.withColumn("k", F.row_number().over(order)).where(F.col("k") <= entities).withColumn("both", F.concat_ws(" ", "entity", "text"))
    again = checkpoint(again.select(F.col("query_no").alias("of"), "k", F.col("both").alias("text"), embed_column(F.col("both"), embedder or hash_embedder()).alias("vector")))
    # each entity's search is a query of its own number
    again = again.withColumn("query_no", F.col("of") * (entities + 1) + F.col("k"))
    two = _round(live, again.select("query_no", "text", "vector"), ROUND_TWO, LEAST).join(again.select("query_no", "of"), "query_no")
    two = two.groupBy(F.col("of").alias("query_no"), "row_no").agg(F.max("score").alias("score"))
    r = one.select("query_no", "row_no", "score", F.lit(1).alias("r")).unionByName(two.withColumn("r", F.lit(2)))
    g = r.groupBy("query_no", "row_no").agg(F.max("score").alias("score"), F.min("r").alias("a"), F.max("r").alias("b"))
    return g.select("query_no", "row_no", "score", F.when(F.col("a") != F.col("b"), "both").when(F.col("a") == 1, "round1").otherwise("round2").alias("source"))
