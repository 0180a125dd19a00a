"""Consolidation: similar rows of one scope and category in clusters, with what to merge, to link, and what conflicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import contradicts
from memspark.operators.skew import join_groups
from memspark.session import checkpoint

#: Score from which rows cluster, and from which they merge (score is 1 / (1 + (1 - cosine))).
CLUSTER, MERGE = 0.82, 0.92
#: Rows of one block; a group beyond it is compared block by block.
BLOCK = 2_000


def similar_pairs(mem: DataFrame, least: float = CLUSTER) -> DataFrame:
    """(a, b, score) of rows of one scope and category with that score, a < b.

    Groups are cut into blocks of ``BLOCK`` rows by hash, and pairs of blocks are compared in numpy, so no group is
    ever in one task. Exact copies of a vector within a group are compared once: they stand for each other as the
    smallest row_no, and each copy is given as one pair with it.
    """
    v = mem.where("vector is not null and size(vector) > 0").select("row_no", "scope", "memory_category", "vector")
    key = ["scope", "memory_category", "h"]
    v = v.withColumn("h", F.sha2(F.to_json("vector"), 256))
    g = v.groupBy(*key).agg(F.min("row_no").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    g = checkpoint(g.where(F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) > 0))
    copies = join_groups(v.select("row_no", *key), g.where("n > 1").select(*key, "rep", "n"), key, "n").where("row_no != rep").select(F.col("rep").alias("a"), F.col("row_no").alias("b"), F.lit(1.0).alias("score"))
    group = ["scope", "memory_category"]
    sizes = g.groupBy(*group).agg(F.count(F.lit(1)).alias("m"))
    r = join_groups(g.select("rep", "vector", *group), sizes.where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")), group, "m")
    r = r.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # each row goes to the pairs of blocks that its own is part of
    spread = r.select("rep", "vector", *group, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        # vectors of different length resemble each other in nothing
        parts = [compare_equal(g.sort_values("rep")) for _, g in f.groupby(f.vector.map(len))]
        return pd.concat(parts) if parts else pd.DataFrame({"a": [], "b": [], "score": []})

    def compare_equal(f: pd.DataFrame) -> pd.DataFrame:
        m = np.array(f.vector.tolist(), np.float64)
        m /= np.linalg.norm(m, axis=1)[:, None]
        score = np.round(1 / (2 - m @ m.T), 9)
        i, j = np.nonzero(np.triu(score >= least, 1))
        blocks = f.block.to_numpy()
        own = (blocks[i] != blocks[j]) | (f.lo.iloc[0] == f.hi.iloc[0])
        rep = f.rep.to_numpy()
        return pd.DataFrame({"a": rep[i][own], "b": rep[j][own], "score": score[i, j][own]})

    found = spread.groupBy(*group, "lo", "hi").applyInPandas(compare, "a bigint, b bigint, score double")
    return copies.unionByName(found)


def clusters(mem: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row_no, seed): greedy clusters in order of row_no. A row is a seed if no earlier seed resembles it; others go
    to the smallest seed that resembles them. Rows that resemble none are left out.

    Rounds follow chains of rows that wait for each other; each is a few joins and decides the smallest row left, so they
    end with none waiting.
    """
    edge = checkpoint(pairs.select("a", "b").distinct())
    waiting = edge
    seeds = checkpoint(edge.select(F.col("a").alias("row_no")).distinct().join(edge.select(F.col("b").alias("row_no")), "row_no", "left_anti"))
    new = seeds
    while not waiting.isEmpty():
        taken = waiting.join(new.select(F.col("row_no").alias("a")), "a", "left_semi").select("b").distinct()
        rest = waiting.join(taken, "b", "left_anti")
        left = checkpoint(rest.join(taken.select(F.col("b").alias("a")), "a", "left_anti"))
        new = checkpoint(rest.select(F.col("b").alias("row_no")).distinct().join(left.select(F.col("b").alias("row_no")), "row_no", "left_anti"))
        seeds = seeds.unionByName(new)
        waiting = left
    member = edge.join(seeds.select(F.col("row_no").alias("a")), "a").join(seeds.select(F.col("row_no").alias("b")), "b", "left_anti").groupBy(F.col("b").alias("row_no")).agg(F.min("a").alias("seed"))
    return member.unionByName(member.select(F.col("seed").alias("row_no"), "seed").distinct())


def consolidation(mem: DataFrame, least: float = CLUSTER, merge: float = MERGE) -> DataFrame:
    """row_no, canonical, action (merge or link), score of each member but the canonical of its cluster.

    The canonical is the row of greatest importance * (1 + ln(accesses + 1)), the smallest row_no on ties. A member's
    score is that with the canonical, or the threshold where they do not resemble each other.
    """
    live = mem.where(F.col("raw_state").isNull() | ~F.col("raw_state").isin("archived", "superseded"))
    pairs = checkpoint(similar_pairs(live, least))
    c = clusters(live, pairs)
    rank = F.struct(F.round(F.col("importance") * (1 + F.log(F.col("access_count") + 1)), 9).alias("r"), (-F.col("row_no")).alias("n"))
    ranked = c.join(live.select("row_no", "importance", "access_count"), "row_no")
    top = ranked.groupBy("seed").agg(F.max(rank).alias("t"), F.count(F.lit(1)).alias("n")).select("seed", (-F.col("t.n")).alias("canonical"), "n")
    member = join_groups(c, top, ["seed"], "n").where("row_no != canonical")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    out = member.join(both.select(F.col("a").alias("canonical"), F.col("b").alias("row_no"), "score").groupBy("canonical", "row_no").agg(F.max("score").alias("score")), ["canonical", "row_no"], "left").withColumn("score", F.coalesce("score", F.lit(least)))
    return out.select("row_no", "canonical", F.when(F.col("score") >= merge, "merge").otherwise("link").alias("action"), "score")


def conflicts(pairs: DataFrame, mem: DataFrame) -> DataFrame:
    """Pairs (a, b, kind) of similar rows that contradict each other or give one fact key different texts."""
    m = mem.select("row_no", "text", "fact_key")
    both = pairs.join(m.toDF("a", "ta", "ka"), "a").join(m.toDF("b", "tb", "kb"), "b")
    kinds = F.array_compact(F.array(F.when(contradicts(F.col("ta"), F.col("tb")), "heuristic_contradiction"), F.when((F.col("ka") == F.col("kb")) & (F.lower(F.trim("ta")) != F.lower(F.trim("tb"))), "fact_key_conflict")))
    return both.select("a", "b", F.explode(kinds).alias("kind"))
