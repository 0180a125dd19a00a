"""Queries on the corpus: metadata, statistics, health, topics, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import score as S
from memspark.functions import text as X
from memspark.functions.norm import scope_key
from memspark.metadata import active_at
from memspark.queries.base import ACTIVE, MEM, NOW, query, smart
from memspark.session import read_table

META = "row_no scope category memory_category tier state source memory_layer access_count confidence feedback_weight valid_from invalidated_at fact_key supersedes superseded_by topic_tag l0 l1 l2".split()


@query("n01_smart_metadata", f"{MEM} select {', '.join(META)} from mem")
def n01(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).select(*META)


@query("s01_scan", "select row_no, id, text, category, scope, importance, timestamp_ms, metadata from memories where scope = 'global'")
def s01(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memories").where("scope = 'global'").select("row_no", "id", "text", "category", "scope", "importance", "timestamp_ms", "metadata")


@query("s02_get_by_id", "select m.row_no, m.id, m.category from memories m where m.id in (select id from incoming_memories union select source_memory_id from kg_triples) and case when m.scope is null or trim(m.scope) = '' then 'global' else lower(trim(m.scope)) end <> 'global'")
def s02(spark: SparkSession, d: str) -> DataFrame:
    ids = read_table(spark, d, "incoming_memories").select("id").union(read_table(spark, d, "kg_triples").select("source_memory_id"))
    return read_table(spark, d, "memories").where(scope_key(F.col("scope")) != "global").join(ids, "id", "left_semi").select("row_no", "id", "category")


@query("f01_scope_filter", "select row_no, id from memories where case when scope is null or trim(scope) = '' then 'global' else lower(trim(scope)) end in ('global') or lower(trim(scope)) like 'agent:%'")
def f01(spark: SparkSession, d: str) -> DataFrame:
    s = scope_key(F.col("scope"))
    return read_table(spark, d, "memories").where((s == "global") | s.startswith("agent:")).select("row_no", "id")


@query("f02_deny_all", "select row_no, id from memories where false")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return X.scoped(read_table(spark, d, "memories"), []).select("row_no", "id")


@query("f04_scope_kinds", r"""with s as (select distinct case when scope is null or trim(scope) = '' then 'global' else lower(trim(scope)) end as scope from memories)
select scope, case when scope = 'global' then 'global' when regexp_matches(scope, '^(agent|custom|project|user|reflection):.+') then split_part(scope, ':', 1) else 'other' end as kind from s""")
def f04(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memories").select(scope_key(F.col("scope")).alias("scope")).distinct().withColumn("kind", X.scope_kind(F.col("scope")))


@query("f07_active", f"{MEM} select row_no, scope from mem where {ACTIVE}")
def f07(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where(active_at(NOW)).select("row_no", "scope")


@query("f09_topic_tag", f"{MEM} select row_no, topic_tag from mem where lower(topic_tag) = 'auth'")
def f09(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where(F.lower("topic_tag") == "auth").select("row_no", "topic_tag")


@query("f10_noise", f"select doc_id, {X.NOISE_SQL.format(c='text')} as is_noise from documents where text is not null")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", X.is_noise(F.col("text")).alias("is_noise"))


@query("f14_category_threshold", f"{MEM} select row_no, memory_category, importance from mem where importance >= case memory_category when 'profile' then 0.25 when 'preferences' then 0.25 when 'entities' then 0.3 when 'events' then 0.35 when 'cases' then 0.45 when 'patterns' then 0.45 else 0.35 end")
def f14(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    return m.where(F.col("importance") >= S.by_name(F.col("memory_category"), X.CATEGORY_THRESHOLDS, 0.35)).select("row_no", "memory_category", "importance")


@query("f16_retrieval_gate", f"select row_no, {X.SKIP_SQL.format(c='text')} as skip from incoming_memories where text is not null")
def f16(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "incoming_memories").where("text is not null").select("row_no", X.skip_retrieval(F.col("text")).alias("skip"))


@query("f17_governance", f"{MEM} select row_no, memory_layer from mem where state = 'confirmed' and memory_layer not in ('archive', 'reflection')")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where((F.col("state") == "confirmed") & ~F.col("memory_layer").isin("archive", "reflection")).select("row_no", "memory_layer")


@query("f21_capture_gate", f"select row_no, {X.CAPTURE_SQL.format(c='text')} as capture from incoming_memories where text is not null")
def f21(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "incoming_memories").where("text is not null").select("row_no", X.should_capture(F.col("text")).alias("capture"))


@query("f24_depth_projection", f"{MEM} select row_no, l0 as d0, l1 as d1, l2 as d2, t as full_text, substr(l2, 1, 200) as d0_cut, substr(l2, 1, 1000) as d1_cut from mem")
def f24(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).select("row_no", F.col("l0").alias("d0"), F.col("l1").alias("d1"), F.col("l2").alias("d2"), F.coalesce("text", F.lit("")).alias("full_text"), F.substring("l2", 1, 200).alias("d0_cut"), F.substring("l2", 1, 1000).alias("d1_cut"))


@query("f25_legacy", f"{MEM} select row_no, category from mem where not has_category")
def f25(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where(~F.col("has_category")).select("row_no", "category")


@query("f26_list_page", f"{MEM} select row_no, id, timestamp_ms from mem where scope = 'global' order by timestamp_ms desc, id limit 20 offset 20")
def f26(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where("scope = 'global'").orderBy(F.desc("timestamp_ms"), "id").offset(20).limit(20).select("row_no", "id", "timestamp_ms")


@query("f28_not_archived", f"{MEM} select row_no from mem where raw_state is null or raw_state not in ('archived', 'superseded')")
def f28(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where(F.col("raw_state").isNull() | ~F.col("raw_state").isin("archived", "superseded")).select("row_no")


@query("a01_stats", f"""{MEM} select 'total' as kind, '' as name, count(*) as n from mem union all select 'scope', scope, count(*) from mem group by scope union all select 'category', coalesce(category, ''), count(*) from mem group by 2""")
def a01(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d).select("scope", F.coalesce("category", F.lit("")).alias("category"))
    g = m.groupingSets([[F.col("scope")], [F.col("category")], []], "scope", "category").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return g.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "scope").otherwise("category").alias("kind"), F.coalesce("scope", "category", F.lit("")).alias("name"), "n")


@query("a03_corpus_health", f"""{MEM}, r as (select row_no, max(case when e->>'$.type' = 'contradicts' then 1 else 0 end) as con from (select row_no, unnest(case when json_type(j->'$.relations') = 'ARRAY' then (j->'$.relations')::json[] else []::json[] end) as e from mem) group by row_no),
h as (select mem.*, coalesce(con, 0) as con from mem left join r using (row_no))
select count(*) filter (where state <> 'archived') as total_active, count(*) filter (where state = 'archived') as total_archived,
  round(avg(importance) filter (where state <> 'archived'), 6) as avg_importance, round(avg(confidence) filter (where state <> 'archived'), 6) as avg_confidence, round(avg(feedback_weight) filter (where state <> 'archived'), 6) as avg_feedback,
  count(*) filter (where state <> 'archived' and {NOW} - timestamp_ms > 60 * 86400000::bigint and access_count < 2 and importance < 0.5) as stale,
  count(*) filter (where superseded_by is not null or supersedes is not null or con = 1) as conflicts,
  round(avg(case when source = 'auto-capture' then 1.0 else 0.0 end), 6) as auto_capture_share, round(avg(case when canonical_id is not null then 1.0 else 0.0 end), 6) as duplicate_rate from h""")
def a03(spark: SparkSession, d: str) -> DataFrame:
    active = F.col("state") != "archived"
    raw = F.get_json_object("metadata", "$.relations")
    types = F.when(F.col("metadata").rlike(r'"relations"\s*:\s*\['), F.from_json(raw, "array<struct<type:string>>")["type"])
    readable = F.from_json("metadata", "map<string,string>").isNotNull()
    con = F.coalesce(readable & F.array_contains(types, "contradicts"), F.lit(False))
    m = smart(spark, d).withColumn("con", con)
    mean = lambda c: F.round(F.avg(F.when(active, F.col(c))), 6)
    return m.agg(
        F.count_if(active).alias("total_active"), F.count_if(~active).alias("total_archived"), mean("importance").alias("avg_importance"), mean("confidence").alias("avg_confidence"), mean("feedback_weight").alias("avg_feedback"),
        F.count_if(active & (F.lit(NOW) - F.col("timestamp_ms") > 60 * 86400000) & (F.col("access_count") < 2) & (F.col("importance") < 0.5)).alias("stale"),
        F.count_if(F.col("superseded_by").isNotNull() | F.col("supersedes").isNotNull() | F.col("con")).alias("conflicts"),
        F.round(F.avg((F.col("source") == "auto-capture").cast("double")), 6).alias("auto_capture_share"), F.round(F.avg(F.col("canonical_id").isNotNull().cast("double")), 6).alias("duplicate_rate"),
    )


@query("a03_distributions", f"{MEM} select 'category' as kind, memory_category as name, count(*) as n from mem group by 2 union all select 'source', source, count(*) from mem group by 2 union all select 'tier', tier, count(*) from mem group by 2")
def a03b(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (("category", "memory_category"), ("source", "source"), ("tier", "tier"))])).alias("p")
    return smart(spark, d).select(pairs).groupBy("p.kind", "p.name").agg(F.count(F.lit(1)).alias("n"))


@query("a04_reject_reasons", r"select regexp_replace(regexp_replace(lower(event_type || ' ' || cast(value as integer)), '\d+(?:\.\d+)?', '#', 'g'), '\s+', ' ', 'g') as reason, count(*) as n from events group by 1 order by n desc, reason limit 5")
def a04(spark: SparkSession, d: str) -> DataFrame:
    reason = X.reason_key(F.concat_ws(" ", "event_type", F.round("value").cast("int").cast("string")))
    return read_table(spark, d, "events").select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(5)


@query("a05_admission_breakdown", f"""{MEM}, a as (select memory_category as category, count(*) as admitted from mem where state = 'confirmed' group by 1), r as (select memory_category as category, count(*) as rejected from mem where state <> 'confirmed' group by 1)
select coalesce(a.category, r.category) as category, coalesce(admitted, 0) as admitted, coalesce(rejected, 0) as rejected, round(coalesce(admitted, 0) / (coalesce(admitted, 0) + coalesce(rejected, 0)), 6) as rate from a full join r on a.category = r.category""")
def a05(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("state") == "confirmed"
    return smart(spark, d).groupBy(F.col("memory_category").alias("category")).agg(F.count_if(ok).alias("admitted"), F.count_if(~ok).alias("rejected"), F.round(F.avg(ok.cast("double")), 6).alias("rate"))


@query("a06_trailing_windows", "with n as (select max(ts) as now from events) select event_type, count(*) filter (where ts > now - interval 1 day) as last24h, count(*) filter (where ts > now - interval 7 day) as last7d, count(*) as total from events, n group by 1")
def a06(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return e.groupBy("event_type").agg(F.count_if(F.col("ts") > now - F.expr("interval 1 day")).alias("last24h"), F.count_if(F.col("ts") > now - F.expr("interval 7 days")).alias("last7d"), F.count(F.lit(1)).alias("total"))


@query("a10_compaction", rf"""{MEM}, k as (select row_no, timestamp_ms, memory_category || ':' || regexp_replace(regexp_replace(lower(l0), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as k, id from mem),
r as (select *, row_number() over (partition by k order by timestamp_ms desc, row_no desc) as rn, first_value(row_no) over (partition by k order by timestamp_ms desc, row_no desc) as kept from k)
select row_no, kept as kept_row_no from r where rn > 1""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d).select("row_no", "timestamp_ms", F.concat_ws(":", "memory_category", F.trim(F.regexp_replace(F.lower("l0"), r"\s+", " "))).alias("k"))
    newest = m.groupBy("k").agg(F.max(F.struct("timestamp_ms", "row_no")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return X.join_groups(m, newest, ["k"], "n").where("row_no != top.row_no").select("row_no", F.col("top.row_no").alias("kept_row_no"))


@query("a14_access_deltas", "select user_id, least(count(*), 10000) as delta, max(ts) as last_ts from events where event_type = 'click' group by 1")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").where("event_type = 'click'").groupBy("user_id").agg(F.least(F.count(F.lit(1)), F.lit(10000)).cast("bigint").alias("delta"), F.max("ts").alias("last_ts"))


@query("a15_support_stats", f"""{MEM}, s as (select row_no, unnest(case when json_type(j->'$.support_info.slices') = 'ARRAY' then (j->'$.support_info.slices')::json[] else []::json[] end) as e from mem)
select row_no, e->>'$.context' as context, sum((e->>'$.confirmations')::bigint)::bigint as confirmations, sum((e->>'$.contradictions')::bigint)::bigint as contradictions from s group by 1, 2""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    whole = F.from_json("metadata", "map<string,string>")["support_info"]
    slices = F.from_json(whole, "struct<slices:array<struct<context:string,confirmations:bigint,contradictions:bigint>>>")["slices"]
    return smart(spark, d).select("row_no", F.inline(slices)).groupBy("row_no", "context").agg(F.sum("confirmations").alias("confirmations"), F.sum("contradictions").alias("contradictions"))


@query("a17_topic", f"select row_no, {X.topic_sql('text')} as topic from incoming_memories where text is not null")
def a17(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "incoming_memories").where("text is not null").select("row_no", X.topic(F.col("text")).alias("topic"))


@query("a19_legacy_count", f"{MEM} select category, count(*) as n from mem where not has_category group by 1")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where(~F.col("has_category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("a20_scope_stats", f"{MEM} select split_part(scope, ':', 1) as kind, count(distinct scope) as scopes, count(*) as memories from mem group by 1")
def a20(spark: SparkSession, d: str) -> DataFrame:
    per = smart(spark, d).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.split_part("scope", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count(F.lit(1)).alias("scopes"), F.sum("n").alias("memories"))


@query("a24_canonical", f"{MEM} select scope, memory_category, arg_max(row_no, (round(importance * (1 + ln(access_count + 1)), 9), -row_no)) as row_no from mem group by 1, 2")
def a24(spark: SparkSession, d: str) -> DataFrame:
    rank = F.struct(F.round(F.col("importance") * (1 + F.log(F.col("access_count") + 1)), 9), -F.col("row_no"))
    return smart(spark, d).groupBy("scope", "memory_category").agg(F.max_by("row_no", rank).alias("row_no"))


@query("w04_last_six", f"{MEM}, r as (select row_no, scope, row_number() over (partition by scope order by timestamp_ms desc, row_no desc) as place from mem) select row_no, scope, place from r where place <= 6")
def w04(spark: SparkSession, d: str) -> DataFrame:
    # Spark cuts each partition's groups before the shuffle (window group limit)
    w = Window.partitionBy("scope").orderBy(F.desc("timestamp_ms"), F.desc("row_no"))
    return smart(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 6").select("row_no", "scope", F.col("place").cast("bigint").alias("place"))


@query("w07_newest_version", f"{MEM}, r as (select row_no, scope, fact_key, row_number() over (partition by scope, fact_key order by valid_from desc, row_no desc) as place, count(*) over (partition by scope, fact_key) as versions from mem where fact_key is not null) select row_no, scope, fact_key, versions from r where place = 1")
def w07(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d).where("fact_key is not null")
    return m.groupBy("scope", "fact_key").agg(F.max(F.struct("valid_from", "row_no")).alias("top"), F.count(F.lit(1)).alias("versions")).select(F.col("top.row_no").alias("row_no"), "scope", "fact_key", "versions")


LIFE = f"""{MEM}, l0 as (select row_no, tier, importance, confidence, feedback_weight, access_count, memory_category, ({NOW} - timestamp_ms) / 86400000.0 as age,
  greatest(0.0, ({NOW} - case when access_count > 0 then last_accessed_at else timestamp_ms end) / 86400000.0) as days, greatest(1.0, (last_accessed_at - timestamp_ms) / 86400000.0) / greatest(access_count - 1, 1) as gap,
  case tier when 'core' then 0.8 when 'peripheral' then 1.3 else 1.0 end as beta, case tier when 'core' then 0.9 when 'peripheral' then 0.5 else 0.7 end as floor_ from mem),
l1 as (select *, exp(-ln(2) / (30 * exp(1.5 * importance)) * pow(days, beta)) as recency, (1 - exp(-access_count / 5.0)) * case when access_count <= 1 then 1.0 else 0.5 + 0.5 * exp(-gap / 30) end as frequency,
  importance * confidence * (0.6 + 0.8 * feedback_weight) as intrinsic from l0),
l2 as (select *, 0.4 * recency + 0.3 * frequency + 0.3 * intrinsic as raw from l1),
l3 as (select *, greatest(raw, floor_) as composite from l2)"""


def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    c, now = F.col, F.lit(NOW)
    m = smart(spark, d)
    m = m.withColumns({"recency": S.decay_recency(now, c("tier"), c("importance"), c("access_count"), c("last_accessed_at"), c("timestamp_ms")), "frequency": S.decay_frequency(c("access_count"), c("last_accessed_at"), c("timestamp_ms")), "intrinsic": S.decay_intrinsic(c("importance"), c("confidence"), c("feedback_weight")), "age": S.age_days(now, c("timestamp_ms"))})
    m = m.withColumn("raw", S.decay_composite(c("recency"), c("frequency"), c("intrinsic")))
    return m.withColumn("composite", S.tier_floor(c("raw"), c("tier")))


@query("m19_decay", f"{LIFE} select row_no, round(recency, 6) as recency, round(frequency, 6) as frequency, round(intrinsic, 6) as intrinsic, round(raw, 6) as raw, round(composite, 6) as composite from l3")
def m19(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle(spark, d).select("row_no", *[F.round(k, 6).alias(k) for k in ("recency", "frequency", "intrinsic", "raw", "composite")])


@query("m19_retention", f"""{LIFE}, p as (select *, case memory_category when 'profile' then 365 when 'preferences' then 180 when 'entities' then 90 when 'events' then 30 when 'cases' then 60 when 'patterns' then 180 else -1 end as keep,
  case memory_category when 'profile' then 0.2 when 'preferences' then 0.3 when 'entities' then 0.5 when 'events' then 1.0 when 'cases' then 0.8 when 'patterns' then 0.3 else 1.0 end as mult from l3)
select row_no, round(greatest(case when age <= keep then greatest(raw, 0.95) when mult > 0 and mult <> 1.0 then 0.4 * exp(-ln(2) / (30 / mult * exp(1.5 * importance)) * pow(greatest(age, 0.0), beta)) + 0.3 * frequency + 0.3 * intrinsic else raw end, floor_), 6) as composite from p""")
def m19b(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    kept = S.retained_composite(c("raw"), c("age"), c("memory_category"), c("tier"), c("importance"), c("frequency"), c("intrinsic"), "default")
    return lifecycle(spark, d).select("row_no", F.round(S.tier_floor(kept, c("tier")), 6).alias("composite"))


@query("m20_search_boost", f"{LIFE} select row_no, round(importance * least(1.0, greatest(0.3, 0.3 + 0.7 * composite)), 6) as boosted from l3")
def m20(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle(spark, d).select("row_no", F.round(S.search_boost(F.col("importance"), F.col("composite")), 6).alias("boosted"))


@query("m21_tier_moves", f"""{LIFE}, t as (select row_no, tier as from_tier, case when tier = 'peripheral' and access_count >= 3 and composite >= 0.4 then 'working' when tier = 'working' and access_count >= 10 and composite >= 0.7 and importance >= 0.8 then 'core'
  when tier = 'working' and (composite < 0.15 or (age > 60 and access_count < 3)) then 'peripheral' when tier = 'core' and composite < 0.15 and access_count < 3 then 'working' else tier end as to_tier from l3)
select * from t where from_tier <> to_tier""")
def m21(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return lifecycle(spark, d).select("row_no", c("tier").alias("from_tier"), S.tier_after(c("tier"), c("access_count"), c("composite"), c("importance"), c("age")).alias("to_tier")).where("from_tier != to_tier")


@query("t10_stale", f"{LIFE} select row_no, round(raw, 6) as raw from l3 where raw < 0.3")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle(spark, d).where("raw < 0.3").select("row_no", F.round("raw", 6).alias("raw"))


@query("m22_homeostasis", f"""{MEM}, n as (select count(*) filter (where tier = 'core') as core from mem)
select core, round(least(case when core > 500 then least(1 + 0.5 * (core - 500) / 500.0, 2.0) else 1.0 end * 0.7, 1.0), 6) as core_threshold from n""")
def m22(spark: SparkSession, d: str) -> DataFrame:
    n = smart(spark, d).agg(F.count_if(F.col("tier") == "core").alias("core"))
    over = F.when(F.col("core") > 500, F.least(1 + 0.5 * (F.col("core") - 500) / 500.0, F.lit(2.0))).otherwise(1.0)
    return n.select("core", F.round(F.least(over * 0.7, F.lit(1.0)), 6).alias("core_threshold"))


@query("m23_confidence_decay", f"{MEM} select row_no, round(0.5 + (confidence - 0.5) * pow(0.5, greatest(0.0, ({NOW} - last_accessed_at) / 86400000.0) / 90), 6) as decayed, round(importance * (0.5 + 0.5 * confidence), 8) as weighted from mem")
def m23(spark: SparkSession, d: str) -> DataFrame:
    days = F.greatest(F.lit(0.0), S.age_days(F.lit(NOW), F.col("last_accessed_at")))
    return smart(spark, d).select("row_no", F.round(0.5 + (F.col("confidence") - 0.5) * F.pow(F.lit(0.5), days / 90), 6).alias("decayed"), F.round(F.col("importance") * (0.5 + 0.5 * F.col("confidence")), 8).alias("weighted"))


@query("m32_bad_recall", f"{MEM} select row_no, bad_recall_count, bad_recall_count >= 3 as suppressed from mem")
def m32(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).select("row_no", "bad_recall_count", (F.col("bad_recall_count") >= 3).alias("suppressed"))


RANK = f"""{MEM}, r as (select row_no, importance as s, length(t) as len, timestamp_ms, access_count, last_accessed_at, importance from mem)"""


@query("m11_rank_stages", f"""{RANK}, h as (select *, case when access_count <= 0 then 60.0 else least(60 + 60 * 0.5 * ln(1 + access_count * pow(2.0, -greatest(0.0, ({NOW} - last_accessed_at) / 86400000.0) / 30)), 180.0) end as hl, ({NOW} - timestamp_ms) / 86400000.0 as age from r)
select row_no, round(greatest(0.0, least(1.0, s + exp(-age / 14) * 0.1)), 6) as recency, round(greatest(0.0, least(1.0, s * (0.7 + 0.3 * importance))), 8) as weighted,
  round(greatest(0.0, least(1.0, s / (1 + 0.5 * log2(greatest(len / 500.0, 1.0))))), 6) as length_norm, round(hl, 6) as half_life, round(greatest(0.0, least(1.0, s * (0.5 + 0.5 * exp(-age / hl)))), 6) as time_decay from h""")
def m11(spark: SparkSession, d: str) -> DataFrame:
    c, now = F.col, F.lit(NOW)
    hl = S.effective_half_life(S.TIME_DECAY_DAYS, c("access_count"), c("last_accessed_at"), now)
    return smart(spark, d).select(
        "row_no", F.round(S.recency_boost(c("importance"), now, c("timestamp_ms")), 6).alias("recency"), F.round(S.importance_weight(c("importance"), c("importance")), 8).alias("weighted"),
        F.round(S.length_norm(c("importance"), F.coalesce("text", F.lit(""))), 6).alias("length_norm"), F.round(hl, 6).alias("half_life"), F.round(S.time_decay(c("importance"), now, c("timestamp_ms"), hl), 6).alias("time_decay"),
    )
