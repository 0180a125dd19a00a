"""Problem 1: full history of changing facts from a stream of updates, by presence bitmaps.

Every standing update of the table gets one slot pair in a global order of (fact, valid_from): slot ``2p`` is the time
it holds, slot ``2p + 1`` the time between its end and the next update of the fact. Per fact and state (a hash of
content and tier) one bit is set for each slot in which the state is present; the slot between two updates counts as
present if it has no length and the next update has the same state, so touching periods join and gaps part them.
Bits lie in 64-bit words keyed by (fact, state, word), so a fact with a third of all rows is many small groups.
Maximal runs of consecutive bits are the versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions.norm import fact_key, scope_key
from memspark.operators.ordered import dense_position
from memspark.operators.skew import join_groups
from memspark.session import checkpoint

WORD = 64
OPEN = -1


def resolve_facts(updates: DataFrame) -> DataFrame:
    """Adds ``scope`` and ``fact_key`` in their normal forms, keyless rows taking those of the row they supersede.

    A superseded row may lack a key too; the chain is followed by pointer doubling, one join per round and as many
    rounds as the number of keyless rows has bits. Chains that lead nowhere or run in a circle leave the row without
    a fact; such rows are dropped.
    """
    rows = updates.withColumns({"scope": scope_key(F.col("scope")), "fact_key": fact_key(F.col("fact_key"))})
    keyed = rows.where(F.col("fact_key").isNotNull())
    lost = rows.where(F.col("fact_key").isNull() & F.col("supersedes").isNotNull())
    by_id = rows.where(F.col("memory_id").isNotNull()).groupBy("memory_id").agg(
        F.min(F.when(F.col("fact_key").isNotNull(), F.struct("scope", "fact_key"))).alias("fact"),
        F.min(F.when(F.col("fact_key").isNull(), F.col("supersedes"))).alias("next"),
    )
    chain = checkpoint(lost.groupBy("supersedes").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("supersedes").alias("start"), F.col("supersedes").alias("at")
    ))
    step = by_id.select(F.col("memory_id").alias("at"), "fact", "next")
    found = None
    # no chain is longer than the keyless rows; round k walks 2**k of them
    for _ in range(lost.count().bit_length() + 1):
        walked = checkpoint(chain.join(step, "at", "inner"))
        done = walked.where(F.col("fact").isNotNull()).select("start", "fact")
        found = done if found is None else found.unionByName(done)
        chain = walked.where(F.col("fact").isNull() & F.col("next").isNotNull()).select("start", F.col("next").alias("at"))
        if chain.isEmpty():
            break
        # doubling: what lies two keyless steps on becomes one step
        onward = step.select(F.col("at").alias("next"), F.col("fact").alias("f2"), F.col("next").alias("n2"))
        step = checkpoint(step.join(onward, "next", "left").select(
            "at", F.coalesce("fact", "f2").alias("fact"), F.when(F.col("fact").isNull() & F.col("f2").isNull(), F.col("n2")).alias("next")
        ))
    counts = lost.groupBy("supersedes").agg(F.count(F.lit(1)).alias("_n"))
    adopted = join_groups(lost.drop("scope", "fact_key"), found.withColumnRenamed("start", "supersedes").join(counts, "supersedes"), ["supersedes"], "_n").drop("_n").select(
        "*", F.col("fact.scope").alias("scope"), F.col("fact.fact_key").alias("fact_key")
    ).drop("fact")
    return keyed.unionByName(adopted.select(*keyed.columns))


def standing_updates(facts: DataFrame) -> DataFrame:
    """Of rows of a fact with the same ``valid_from`` the one received last (ties: the larger ``update_no``)."""
    start = F.coalesce("valid_from", "timestamp_ms")
    last = F.struct("received_at", "update_no", "l2_content", "tier", "invalidated_at")
    return (
        facts.withColumn("valid_from", start)
        .where(F.col("valid_from").isNotNull())
        .groupBy("scope", "fact_key", "valid_from")
        .agg(F.max(last).alias("u"))
        .select("scope", "fact_key", "valid_from", "u.l2_content", "u.tier", "u.invalidated_at")
    )


def fact_history(updates: DataFrame) -> DataFrame:
    """Versions of every fact: scope, fact_key, valid_from, valid_to (exclusive, -1 if open), l2_content, tier.

    Null contents and tiers are values like others. An ``invalidated_at`` before ``valid_from`` is ignored; one equal
    to it gives a period without length, which is no version. Empty input gives no rows. Further columns are ignored.
    """
    need = "update_no memory_id scope fact_key l2_content tier valid_from invalidated_at supersedes timestamp_ms received_at".split()
    rows = standing_updates(resolve_facts(updates.select(*need)))
    state = F.sha2(F.to_json(F.struct("l2_content", "tier")), 256)
    rows = dense_position(rows.withColumn("state", state), ["scope", "fact_key", "valid_from"])
    nxt = rows.select((F.col("pos") - 1).alias("pos"), F.col("scope").alias("ns"), F.col("fact_key").alias("nk"), F.col("valid_from").alias("nv"), F.col("state").alias("nst"))
    rows = rows.join(nxt, "pos", "left")
    same = (F.col("ns") == F.col("scope")) & (F.col("nk") == F.col("fact_key"))
    until = F.when(same, F.col("nv"))
    own = F.when(F.col("invalidated_at") >= F.col("valid_from"), F.col("invalidated_at"))
    end = F.coalesce(F.least(until, own), until, own)
    rows = rows.withColumn("end", end).withColumn("bridge", F.coalesce(same & (F.col("end") == F.col("nv")) & (F.col("nst") == F.col("state")), F.lit(False)))
    # a period without length holds nothing: it neither sets its bit nor bridges
    rows = checkpoint(rows.where(F.col("end").isNull() | (F.col("end") > F.col("valid_from"))).select("scope", "fact_key", "valid_from", "end", "state", "bridge", "pos", "l2_content", "tier"))

    slot = F.explode(F.when(F.col("bridge"), F.array(F.col("pos") * 2, F.col("pos") * 2 + 1)).otherwise(F.array(F.col("pos") * 2)))
    bits = rows.select("scope", "fact_key", "state", slot.alias("slot")).select(
        "scope", "fact_key", "state", F.floor(F.col("slot") / WORD).cast("bigint").alias("word"), F.expr(f"shiftleft(1L, cast(slot % {WORD} as int))").alias("bit")
    )
    words = checkpoint(bits.groupBy("scope", "fact_key", "state", "word").agg(F.bit_or("bit").alias("bits")))
    # carry in: the last bit of the word before; carry out: the first bit of the word after
    key = ["scope", "fact_key", "state", "word"]
    before = words.select("scope", "fact_key", "state", (F.col("word") + 1).alias("word"), F.expr(f"shiftrightunsigned(bits, {WORD - 1})").alias("carry_in"))
    after = words.select("scope", "fact_key", "state", (F.col("word") - 1).alias("word"), F.expr(f"shiftleft(bits, {WORD - 1})").alias("carry_out"))
    edged = words.join(before, key, "left").join(after, key, "left").na.fill(0, ["carry_in", "carry_out"])
    starts = F.expr("bits & ~(shiftleft(bits, 1) | carry_in)")
    ends = F.expr("bits & ~(shiftrightunsigned(bits, 1) | carry_out)")
    listed = lambda b: F.expr(f"filter(transform(sequence(0, {WORD - 1}), i -> if((shiftrightunsigned({b}, i) & 1L) = 1L, word * {WORD} + i, null)), x -> x is not null)")
    edges = edged.withColumns({"s": starts, "e": ends}).where("s != 0 or e != 0")
    edge_rows = edges.select(F.explode(listed("s")).alias("slot"), F.lit(0).alias("is_end")).unionByName(edges.select(F.explode(listed("e")).alias("slot"), F.lit(1).alias("is_end")))
    # slots are global and runs never overlap, so in slot order each start is followed by its own end
    ordered = dense_position(edge_rows, ["slot", "is_end"], "k")
    opened = ordered.where("is_end = 0").select("k", F.floor(F.col("slot") / 2).cast("bigint").alias("first_pos"))
    closed = ordered.where("is_end = 1").select((F.col("k") - 1).alias("k"), F.floor(F.col("slot") / 2).cast("bigint").alias("last_pos"))
    runs = opened.join(closed, "k")
    first = rows.select(F.col("pos").alias("first_pos"), "scope", "fact_key", "valid_from", "l2_content", "tier")
    last = rows.select(F.col("pos").alias("last_pos"), F.coalesce("end", F.lit(OPEN)).alias("valid_to"))
    return runs.join(first, "first_pos").join(last, "last_pos").select("scope", "fact_key", "valid_from", "valid_to", "l2_content", "tier")
