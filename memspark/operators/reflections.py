"""Lines of stored reflections, weighed by age, weight and quality, and ranked over all rows that say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: By kind the middle in days, the steepness, the weight and the quality of a reflection's decay.
KINDS = {
    "decision": (45.0, 0.25, 1.1, 1.0), "user-model": (21.0, 0.3, 1.0, 0.95), "agent-model": (10.0, 0.35, 0.95, 0.93), "lesson": (7.0, 0.45, 0.9, 0.9),
    "invariant": (45.0, 0.22, 1.1, 1.0), "derived": (7.0, 0.65, 1.0, 0.95),
}
#: Factor of reflections made without a model, oldest mapped and derived lines in days, lines given.
FALLBACK, MAPPED_DAYS, DERIVED_DAYS, PER_KIND = 0.75, 60, 14, 10
MAPPED = ("user-model", "agent-model", "lesson", "decision")
DAY = 86_400_000.0


def logistic(age_days: Column, middle: Column, steep: Column) -> Column:
    """1 / (1 + exp(steep (age - middle))); ages under 0 count as 0, a middle that is not over 0 as 1, such a steepness as 0.1."""
    age = F.when(age_days.isNull() | F.isnan(age_days), 0.0).otherwise(F.greatest(F.lit(0.0), age_days))
    return 1 / (1 + F.exp(F.when(steep > 0, steep).otherwise(0.1) * (age - F.when(middle > 0, middle).otherwise(1.0))))


def score(age_days: Column, middle: Column, steep: Column, weight: Column, quality: Column, fallback: Column) -> Column:
    """The decay times weight (1 if not over 0), quality (within 0 and 1; 1 if missing), and 0.75 for a fallback."""
    q = F.when(quality.isNull() | F.isnan(quality), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)))
    return logistic(age_days, middle, steep) * F.when(weight > 0, weight).otherwise(1.0) * q * F.when(fallback, FALLBACK).otherwise(1.0)


def plain_line(c: Column) -> Column:
    """A line without emphasis, label and white space around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\*\*", ""), r"(?i)^(invariants?|reflections?|derived)[:：]\s*", ""))


#: Lines that say there is nothing.
NOTHING = r"(?i)^\(none( captured)?\)$|^(invariants?|reflections?|derived)[:：]$|apply this session'?s (deltas|distilled changes) next run|investigate why embedded reflection generation failed"


def is_placeholder(line: Column) -> Column:
    """True for empty lines and those that say there is nothing."""
    t = F.trim(F.regexp_replace(line, r"\*\*", ""))
    return (t == "") | t.rlike(NOTHING)


def weighted_lines(mem: DataFrame, now: int, agent: str | None = None, kinds: tuple[str, ...] = MAPPED) -> DataFrame:
    """row_no, kind, line, at, age_ms, score of each line of reflections of ``kinds`` that ``agent`` may see.

    ``mem``: row_no, text, timestamp_ms, metadata. A row's kind is its metadata's ``mappedKind`` (of mapped reflections)
    or ``itemKind``; what its metadata says of decay, weight and quality counts before the kind's own. Rows of no owner
    and of ``main`` are seen by all. Null texts and unreadable metadata give no line.
    """
    m = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    d = mem.select("row_no", "text", "timestamp_ms", m.alias("m"))
    get = lambda k: F.col("m")[k]
    kind = F.when(get("type") == "memory-reflection-mapped", get("mappedKind")).when(get("type") == "memory-reflection-item", get("itemKind"))
    table = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[i])]), F.col("kind"))
    over = lambda k, i: F.when(get(k).try_cast("double") > 0, get(k).try_cast("double")).otherwise(table(i))
    stored = get("storedAt").try_cast("double")
    owner = F.trim(F.coalesce(get("agentId"), F.lit("")))
    d = d.withColumn("kind", kind).where(F.col("kind").isin(*kinds) & (F.lit(True) if agent is None else owner.isin("", agent, "main")))
    d = d.withColumn("at", F.when(stored > 0, stored.cast("bigint")).otherwise(F.coalesce("timestamp_ms", F.lit(now))))
    quality = F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.coalesce(get("quality").try_cast("double"), table(3))))
    s = score((F.lit(now) - F.col("at")) / DAY, over("decayMidpointDays", 0), over("decayK", 1), over("baseWeight", 2), quality, F.coalesce(get("usedFallback") == "true", F.lit(False)))
    lines = d.select("row_no", "kind", "at", (F.lit(now) - F.col("at")).alias("age_ms"), s.alias("score"), plain_line(F.coalesce("text", F.lit(""))).alias("line"))
    return lines.where(~is_placeholder(F.col("line")))


def ranked_lines(lines: DataFrame, limit: int = PER_KIND, max_days: float | None = MAPPED_DAYS) -> DataFrame:
    """kind, place, line, score, latest: of each kind the best lines, those that are equal but for case and white space
    taken together (scores added, the newest wording). Lines older than ``max_days`` are left out. The first of a kind are
    cut before the shuffle."""
    if max_days is not None:
        lines = lines.where(F.col("age_ms") <= max_days * DAY)
    key = F.lower(F.regexp_replace(F.trim("line"), r"\s+", " "))
    g = lines.where("score > 0").groupBy("kind", key.alias("key")).agg(F.round(F.sum("score"), 9).alias("score"), F.max("at").alias("latest"), F.max(F.struct("at", "line"))["line"].alias("line"))
    w = Window.partitionBy("kind").orderBy(F.desc("score"), F.desc("latest"), "line")
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select("kind", "place", "line", "score", "latest")
