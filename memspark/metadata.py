"""The smart metadata of a memory row as columns: JSON read once, defaults filled in, values clamped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.norm import scope_key

#: Names of tiers, states, sources and layers, defaults of counts and weights.
TIERS = ("core", "working", "peripheral")
STATES = ("pending", "confirmed", "archived")
SOURCES = ("manual", "auto-capture", "reflection", "session-summary", "consolidation", "legacy")
LAYERS = ("durable", "working", "reflection", "archive")
STORAGE_TO_SEMANTIC = {"preference": "preferences", "entity": "entities", "decision": "events", "other": "patterns"}
SEMANTIC_TO_STORAGE = {"profile": "fact", "preferences": "preference", "entities": "entity", "events": "decision", "cases": "fact", "patterns": "other"}
VERSIONED = ("preferences", "entities")
IDENTITY = r"(?i)\b(my |i am |i'm |name is |叫我|我的|我是)\b"
DEFAULT_CONFIDENCE, DEFAULT_FEEDBACK, DEFAULT_IMPORTANCE = 0.7, 0.5, 0.7


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def text_or(c: Column, fallback: Column) -> Column:
    """The trimmed text, or the fallback where it is null or blank."""
    return F.when(strip(c) != "", strip(c)).otherwise(fallback)


def one_of(c: Column, names: tuple[str, ...], default: str | Column) -> Column:
    return F.when(c.isin(*names), c).otherwise(default)


def semantic_category(category: Column, text: Column) -> Column:
    """Semantic category of a storage category; a short fact about the user is a profile."""
    out = F.when((category == "fact") & F.coalesce(text, F.lit("")).rlike(IDENTITY) & (F.length(text) < 200), F.lit("profile")).when(category == "fact", F.lit("cases"))
    for k, v in STORAGE_TO_SEMANTIC.items():
        out = out.when(category == k, F.lit(v))
    return out.otherwise("patterns")


def fact_topic(abstract: Column) -> Column:
    """Text before a colon or arrow (up to 120 characters), else all of it, in the normal form of fact keys; null if blank."""
    t = strip(abstract)
    colon, arrow = F.regexp_extract(t, r"^(.{1,120}?)[：:]", 1), F.regexp_extract(t, r"^(.{1,120}?)(?:\s*->|\s*=>)", 1)
    topic = F.when(colon != "", colon).when(arrow != "", arrow).otherwise(t)
    key = strip(F.regexp_replace(F.regexp_replace(F.lower(topic), r"\s+", " "), r"[。.!?]+$", ""))
    return F.when(key != "", key)


def store_rows(memories: DataFrame) -> DataFrame:
    """One row per id, the first accepted; redelivered rows are dropped. Rows without id stay."""
    first = memories.where("id is not null").groupBy("id").agg(F.min("row_no").alias("row_no")).select("row_no")
    return memories.join(first.unionByName(memories.where("id is null").select("row_no")), "row_no", "left_semi")


def with_smart_meta(df: DataFrame) -> DataFrame:
    """``df`` of memory rows with normalised metadata columns.

    Unreadable or missing metadata counts as empty. Numbers given as text count; a JSON null counts as 0 where a
    number is wanted. Keeps row_no, id, text, category, scope, importance, timestamp_ms and all vectors it finds.
    """
    m = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    keep = [c for c in ("row_no", "id", "text", "category", "timestamp_ms", "vector", "vector_l0", "vector_l1", "vector_l2", "metadata") if c in df.columns]
    d = df.select(*keep, scope_key(F.col("scope")).alias("scope"), F.coalesce("importance", F.lit(DEFAULT_IMPORTANCE)).alias("importance"), m.alias("m"))
    get = lambda k: F.col("m")[k]

    def number(k: str) -> Column:
        v = get(k)
        return F.when(F.map_contains_key("m", k) & (v.isNull() | (F.trim(v) == "")), F.lit(0.0)).otherwise(v.try_cast("double"))

    def count(k: str, default: Column) -> Column:
        n = number(k)
        return F.when((n >= 0) & (n < 9e18), F.floor(n).cast("bigint")).otherwise(default)

    def stamp(k: str) -> Column:
        n = number(k)
        return F.when((n > 0) & (n < 9e18), F.floor(n).cast("bigint"))

    def share(n: Column, default: float) -> Column:
        # least and greatest skip nulls, so a missing number must be told apart first
        return F.when(n.isNull() | F.isnan(n), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))

    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("bigint")
    d = d.withColumns(
        {
            "l0": text_or(get("l0_abstract"), text),
            "l2": text_or(get("l2_content"), text),
            "derived_category": semantic_category(F.col("category"), F.col("text")),
            "source": one_of(F.coalesce(get("source"), F.when(get("type") == "session-summary", "session-summary").when(get("type").isin("memory-reflection", "memory-reflection-item"), "reflection").otherwise("legacy")), SOURCES, "legacy"),
            "tier": one_of(get("tier"), TIERS, "working"),
            "access_count": count("access_count", zero),
            "confidence": share(number("confidence"), DEFAULT_CONFIDENCE),
            "feedback_weight": share(get("feedback_weight").try_cast("double"), DEFAULT_FEEDBACK),
            "last_accessed_at": count("last_accessed_at", F.col("timestamp_ms")),
            "valid_from": F.coalesce(stamp("valid_from"), F.col("timestamp_ms")),
            "_inval": stamp("invalidated_at"),
            "supersedes": text_or(get("supersedes"), F.lit(None)),
            "superseded_by": text_or(get("superseded_by"), F.lit(None)),
            "canonical_id": text_or(get("canonical_id"), F.lit(None)),
            "topic_tag": get("topic_tag"),
            "bad_recall_count": count("bad_recall_count", zero),
            "raw_state": get("state"),
            "has_category": get("memory_category").isNotNull(),
        }
    )
    d = d.withColumns(
        {
            "l1": text_or(get("l1_overview"), F.concat(F.lit("- "), F.col("l0"))),
            "memory_category": F.coalesce(get("memory_category"), "derived_category"),
            "state": one_of(F.coalesce(get("state"), F.when(F.col("source") == "session-summary", "archived").otherwise("confirmed")), STATES, "confirmed"),
            "invalidated_at": F.when(F.col("_inval") >= F.col("valid_from"), F.col("_inval")),
        }
    )
    layer = F.when(F.col("source").isin("reflection", "session-summary"), "reflection").when(F.col("state") == "archived", "archive").when(F.col("derived_category").isin("profile", "preferences", "events"), "durable").otherwise("working")
    derived = F.when(F.col("memory_category").isin(*VERSIONED), F.concat("memory_category", F.lit(":"), fact_topic(F.col("l0"))))
    return d.withColumns({"memory_layer": one_of(F.coalesce(get("memory_layer"), layer), LAYERS, "working"), "fact_key": F.coalesce(text_or(get("fact_key"), F.lit(None)), derived)}).drop("_inval", "m")


def active_at(now: int | Column) -> Column:
    """Valid at ``now``; the state does not matter."""
    at = F.lit(now)
    return (F.col("valid_from") <= at) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > at))
