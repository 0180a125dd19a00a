"""The knowledge graph: upserts, neighbourhoods, personalised PageRank, and the memories its triples came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.norm import scope_key
from memspark.functions.score import by_name
from memspark.session import checkpoint

#: Weights of predicates, and of all others.
PREDICATES = {
    "created_by": 0.95, "depends_on": 0.90, "uses": 0.90, "works_with": 0.80, "works_at": 0.80, "friend_of": 0.75, "member_of": 0.75, "knows": 0.75, "manages": 0.75, "built": 0.85,
    "wrote": 0.85, "prefers": 0.70, "discussed": 0.70, "lives_in": 0.70, "located_in": 0.70, "mentioned_in": 0.60, "related_to": 0.50, "is_a": 0.80, "has": 0.75,
}
OTHER_PREDICATE = 0.60
DAMPING, ITERATIONS, TOLERANCE, HOPS, TOP = 0.85, 10, 0.001, 2, 20


def entity_name(c: Column) -> Column:
    """Quotes and brackets off, white space collapsed, Latin names in title case, names with Han characters as they are."""
    edge = r"""[\s"'“”‘’「」『』【】\[\]()（）]+"""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^" + edge, ""), edge + "$", ""), r"\s+", " "))
    return F.when(t.rlike("[一-鿿㐀-䶿]"), t).otherwise(F.initcap(F.lower(t)))


def predicate_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_"), r"[^a-z0-9_一-鿿]", "")


def triple_id(scope: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    """First 32 hexadecimal digits of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", scope, subject, predicate, obj), 256), 1, 32)


def upserted(triples: DataFrame) -> DataFrame:
    """One row per id, the last by timestamp (then the higher confidence); names normalised, null confidence 0.

    Triples without subject or object are dropped; null scopes are ``global``.
    """
    order = F.struct(F.coalesce("timestamp_ms", F.lit(0)).alias("t"), F.coalesce("confidence", F.lit(0.0)).alias("c"))
    last = triples.groupBy("id").agg(F.max_by(F.struct("scope", "subject", "predicate", "object", "source_memory_id"), order).alias("r"), F.max(order).alias("o"))
    return last.select("id", scope_key(F.col("r.scope")).alias("scope"), entity_name(F.col("r.subject")).alias("subject"), predicate_name(F.col("r.predicate")).alias("predicate"), entity_name(F.col("r.object")).alias("object"), F.col("o.c").alias("confidence"), F.col("r.source_memory_id").alias("source_memory_id")).where("subject is not null and object is not null")


def edges(triples: DataFrame) -> DataFrame:
    """Undirected edges (src, dst, w) of upserted triples; parallel edges stay."""
    w = by_name(F.col("predicate"), PREDICATES, OTHER_PREDICATE) * F.col("confidence")
    return triples.select(F.inline(F.array(F.struct(F.col("subject").alias("src"), F.col("object").alias("dst"), w.alias("w")), F.struct(F.col("object").alias("src"), F.col("subject").alias("dst"), w.alias("w")))))


def neighbourhood(edge: DataFrame, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """entity, hops: least number of steps from a seed, up to ``hops``. One join per step, each entity once."""
    step = edge.select("src", "dst").distinct()
    seen = seeds.select(F.col("entity"), F.lit(0).alias("hops")).distinct()
    frontier = seen
    for h in range(1, hops + 1):
        reached = frontier.join(step, frontier["entity"] == step["src"]).select(F.col("dst").alias("entity")).distinct()
        frontier = reached.join(seen, "entity", "left_anti").select("entity", F.lit(h).alias("hops"))
        seen = checkpoint(seen.unionByName(frontier))
        frontier = seen.where(F.col("hops") == h)
    return seen


def pagerank(edge: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """entity, score of personalised PageRank from seeds that are in the graph.

    Each iteration is one join and one partial aggregation; it ends early once no score moves by ``tolerance``.
    Entities without edge weight pass nothing on.
    """
    total = edge.groupBy("src").agg(F.sum("w").alias("total"))
    flow = checkpoint(edge.groupBy("src", "dst").agg(F.sum("w").alias("w")).join(total.where("total > 0"), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = edge.select(F.col("src").alias("entity")).distinct()
    start = checkpoint(seeds.select("entity").distinct().join(nodes, "entity", "left_semi"))
    n = start.count()
    if not n:
        return start.select("entity", F.lit(0.0).alias("score"))
    home = start.select("entity", F.lit(1.0 / n).alias("seed"))
    scores = home.select("entity", F.col("seed").alias("score"))
    for _ in range(iterations):
        spread = scores.join(flow, scores["entity"] == flow["src"]).select(F.col("dst").alias("entity"), (damping * F.col("score") * F.col("p")).alias("part"))
        both = spread.unionByName(home.select("entity", ((1 - damping) * F.col("seed")).alias("part")))
        new = checkpoint(both.groupBy("entity").agg(F.sum("part").alias("score")))
        moved = new.join(scores.withColumnRenamed("score", "old"), "entity", "full").agg(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        scores = new
        if moved is not None and moved < tolerance:
            break
    return scores


def memories_of(triples: DataFrame, scores: DataFrame, top: int = TOP) -> DataFrame:
    """source_memory_id, score: of each memory the best of max(subject, object score) times confidence; the ``top`` best."""
    s = scores.select(F.col("entity").alias("subject"), F.col("score").alias("s"))
    o = scores.select(F.col("entity").alias("object"), F.col("score").alias("o"))
    best = F.greatest(F.coalesce("s", F.lit(0.0)), F.coalesce("o", F.lit(0.0))) * F.col("confidence")
    hit = triples.where("source_memory_id is not null").join(s, "subject", "left").join(o, "object", "left").withColumn("score", best).where("score > 0")
    return hit.groupBy("source_memory_id").agg(F.max("score").alias("score")).orderBy(F.desc(F.round("score", 6)), "source_memory_id").limit(top)
