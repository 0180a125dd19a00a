"""Problem 9: mixing sources to target weights of the total size in tokens.

Documents get hash-random keys and are range-sorted within their source; distributed prefix sums of token counts give
each document its place, and each source is cut at its budget. A budget over the source's size takes whole epochs and
cuts the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.encoding import VOCABULARY, token_counts
from memspark.operators.ordered import prefix_sum
from memspark.session import checkpoint, widen

#: Rows of the target table up to which it is broadcast.
TARGETS_BROADCAST = 10_000


def source_key(c: Column) -> Column:
    """Source in lower case, trimmed, with hyphens for spaces and underscores; null if blank."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^[\s_-]+|[\s_-]+$", ""), r"(?U)[\s_]+", "-")
    return F.when(t != "", t)


def sized(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens; null and empty texts have 0 tokens, documents without a source are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = pa.array(token_counts(b.column("text").to_pylist(), vocabulary), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), counts], names=["doc_id", "source", "tokens"])

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), "text").where(F.col("source").isNotNull())
    return widen(base, "doc_id").mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def budgets(targets: DataFrame, sizes: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """mix_name, source, target_share, max_repeats, size, budget, binds per target with a weight over 0.

    Without ``total_tokens`` the total of a mix is the largest at which every source that has tokens reaches its share
    within its repeats. Shares are relative to the sources that have tokens; others have size and budget 0. With it,
    budgets are cut at ``max_repeats`` times the size. Repeated targets of one source are added up, negative and null
    weights count as 0, null ``max_repeats`` as 1.
    """
    t = targets.select("mix_name", source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    t = t.groupBy("mix_name", "source").agg(F.sum("w").alias("w"), F.max("max_repeats").alias("max_repeats")).where("w > 0 and source is not null")
    t = t.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    cap = F.col("max_repeats") * F.col("size")
    sums = t.groupBy("mix_name").agg(F.sum("w").alias("all_w"), F.sum(F.when(cap > 0, F.col("w"))).alias("there_w"), F.min(F.when(cap > 0, cap / F.col("w"))).alias("per_w"))
    t = t.join(sums, "mix_name")
    wanted = F.col("w") * F.col("per_w") if total_tokens is None else F.least(F.col("w") / F.col("there_w") * total_tokens, cap)
    return t.select("mix_name", "source", (F.col("w") / F.col("all_w")).alias("target_share"), "max_repeats", "size", F.when(cap > 0, F.floor(wanted)).otherwise(0).cast("bigint").alias("budget"), ((cap > 0) & (wanted >= cap * (1 - 1e-12))).alias("binds"))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares). chosen: mix_name, source, doc_id, tokens, repeats (1 or more). shares: what each source gives, and
    whether it binds: all it may give is taken, so that more of the mix cannot be had at these shares.

    Whole documents are taken: the last one counts if at least half of it lies within the budget, so a source misses
    its budget by at most half a document. Documents with the same ``doc_id`` are ordered by size.
    """
    # kept before the range sort, whose sampling would count the tokens once more
    placed = prefix_sum(checkpoint(sized(docs, vocabulary)).withColumn("key", F.xxhash64("doc_id", F.lit(seed))), "source", ["key", "doc_id", "tokens"], "tokens")
    sizes = placed.groupBy("source").agg(F.sum("tokens").alias("size"))
    plan = checkpoint(budgets(targets, sizes, total_tokens))
    plan_small = F.broadcast(plan) if plan.count() <= TARGETS_BROADCAST else plan
    with_plan = placed.join(plan_small.where("budget > 0"), "source")
    whole = F.floor(F.col("budget") / F.col("size"))
    rest = F.col("budget") - whole * F.col("size")
    last = ((F.col("before") + F.col("tokens") / 2 <= rest) & (rest > 0) & (whole < F.col("max_repeats"))).cast("int")
    chosen = with_plan.withColumn("repeats", (whole + last).cast("int")).where("repeats > 0").select("mix_name", "source", "doc_id", "tokens", "repeats")
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    shares = plan.join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    all_ = shares.groupBy("mix_name").agg(F.sum("tokens").alias("_all"))
    shares = shares.join(all_, "mix_name").withColumn("actual_share", F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0)).drop("_all")
    return chosen, shares.select("mix_name", "source", "target_share", "actual_share", "max_repeats", "most_repeats", "size", "budget", "tokens", "documents", "binds")
