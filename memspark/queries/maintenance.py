"""Queries that change or prepare the store: ids, imports, upgrades, conflicts, consolidation, capture, conversations, streams."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.functions.ids import memory_id
from memspark.functions.norm import scope_key, words
from memspark.functions.temporal import with_temporal
from memspark.metadata import store_rows
from memspark.operators import store as O
from memspark.operators.consolidate import conflicts, consolidation, similar_pairs
from memspark.operators.ordered import place_in_group, with_neighbour
from memspark.queries.base import MEM, NOW, query, smart
from memspark.session import read_table
from memspark.sources.conversations import plaintext_turns
from memspark.streaming import jobs

SC = "case when scope is null or trim(scope) = '' then 'global' else lower(trim(scope)) end"
HEX = "sha1(unhex('7f3e8a2b4c5d4e6f8a9b1c2d3e4f5a6b') || encode(concat({s}, chr(0), coalesce(text, ''))))"
UUID = lambda h: f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), '5' || substr({h}, 14, 3), substr('89ab', 1 + (('0x' || substr({h}, 17, 1))::int & 3), 1) || substr({h}, 18, 3), substr({h}, 21, 12))"
IDS = f"h as (select *, {HEX.format(s=SC)} as h from incoming_memories), u as (select *, {UUID('h')} as new_id from h)"


def incoming(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "incoming_memories")


@query("x01_uuid5", f"with {IDS} select row_no, new_id from u")
def x01(spark: SparkSession, d: str) -> DataFrame:
    return incoming(spark, d).select("row_no", memory_id(scope_key(F.col("scope")), F.col("text")).alias("new_id"))


@query("s03_migrate_defaults", "select row_no, coalesce(scope, 'global') as scope, coalesce(timestamp_ms, 0) as timestamp_ms, coalesce(metadata, '{}') as metadata from memories")
def s03(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memories").select("row_no", F.coalesce("scope", F.lit("global")).alias("scope"), F.coalesce("timestamp_ms", F.lit(0)).cast("bigint").alias("timestamp_ms"), F.coalesce("metadata", F.lit("{}")).alias("metadata"))


@query("s04_layer_vectors", "select row_no, (vector_l0 is null)::int + (vector_l1 is null)::int + (vector_l2 is null)::int as filled, len(coalesce(vector_l0, list_transform(range(32), lambda i: 0.0::float))) as dim from memories")
def s04(spark: SparkSession, d: str) -> DataFrame:
    zero = F.array_repeat(F.lit(0.0).cast("float"), 32)
    m = read_table(spark, d, "memories")
    layers = {c: F.coalesce(c, zero) for c in ("vector_l0", "vector_l1", "vector_l2")}
    filled = sum((F.col(c).isNull().cast("int") for c in layers), F.lit(0))
    return m.withColumn("filled", filled).withColumns(layers).select("row_no", "filled", F.size("vector_l0").cast("bigint").alias("dim"))


@query("s05_store", f"with {IDS}, f as (select new_id, min(row_no) as row_no from u group by 1) select row_no, new_id from f where new_id not in (select id from memories where id is not null)")
def s05(spark: SparkSession, d: str) -> DataFrame:
    batch = O.with_ids(incoming(spark, d))
    return O.new_rows(read_table(spark, d, "memories"), batch, "row_no").select("row_no", F.col("id").alias("new_id"))


@query("s06_import", "select row_no, round(greatest(0.0, least(1.0, coalesce(importance, 0.7))), 6) as importance from incoming_memories where length(trim(coalesce(text, ''))) >= 2 and id not in (select id from memories where id is not null)")
def s06(spark: SparkSession, d: str) -> DataFrame:
    return O.importable(read_table(spark, d, "memories"), incoming(spark, d)).select("row_no", F.round("importance", 6).alias("importance"))


@query("s07_update", "with p as (select source_memory_id as id, max(coalesce(confidence, 0.0)) as c from kg_triples where source_memory_id is not null group by 1) select m.row_no, round(coalesce(p.c, m.importance), 6) as importance from memories m left join p using (id)")
def s07(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "kg_triples").where("source_memory_id is not null").groupBy(F.col("source_memory_id").alias("id")).agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("importance"))
    return O.patch(read_table(spark, d, "memories"), p, ["importance"]).select("row_no", F.round("importance", 6).alias("importance"))


@query("s07_prefix", "with a as (select distinct substr(source_memory_id, 1, 8) as ref from kg_triples where source_memory_id is not null), s as (select distinct id from memories where id is not null), h as (select ref, min(id) as id, count(*) as n from a join s on starts_with(id, ref) group by 1) select a.ref, case when n = 1 then id end as id from a left join h using (ref)")
def s07b(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "kg_triples").where("source_memory_id is not null").select(F.substring("source_memory_id", 1, 8).alias("ref")).distinct()
    return O.resolve_prefix(read_table(spark, d, "memories"), a)


@query("s08_patch_metadata", f"{MEM}, r as (select distinct source_memory_id as id from kg_triples) select row_no, case when id in (select id from r where id is not null) then 'kg' else topic_tag end as topic_tag, confidence from mem")
def s08(spark: SparkSession, d: str) -> DataFrame:
    from memspark.metadata import with_smart_meta

    ids = read_table(spark, d, "kg_triples").select(F.col("source_memory_id").alias("id")).distinct().withColumn("patch", F.create_map(F.lit("topic_tag"), F.lit('"kg"')))
    return with_smart_meta(O.patch_metadata(store_rows(read_table(spark, d, "memories")), ids)).select("row_no", "topic_tag", "confidence")


@query("s09_delete", "select row_no from memories where id is null or id not in (select source_memory_id from kg_triples where source_memory_id is not null)")
def s09(spark: SparkSession, d: str) -> DataFrame:
    return O.delete(read_table(spark, d, "memories"), read_table(spark, d, "kg_triples").select(F.col("source_memory_id").alias("id"))).select("row_no")


@query("s10_bulk_delete", f"select row_no from memories where not ({SC} in ('global') and timestamp_ms < 1735689600000)")
def s10(spark: SparkSession, d: str) -> DataFrame:
    return O.bulk_delete(read_table(spark, d, "memories"), ["global"], 1735689600000).select("row_no")


@query("s13_export", f"{MEM} select row_no, id, t as text, category, scope, round(importance, 6) as importance, timestamp_ms from mem")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).select("row_no", "id", F.coalesce("text", F.lit("")).alias("text"), "category", "scope", F.round("importance", 6).alias("importance"), "timestamp_ms")


@query("s17_upgrade", rf"{MEM}, s as (select row_no, derived_category, regexp_replace(t, '^\s+|\s+$', '', 'g') as b from mem where not has_category) select row_no, derived_category, substr(coalesce(nullif(regexp_extract(b, '^([^.!?。！？\n]+[.!?。！？]?)', 1), ''), b), 1, 100) as l0 from s")
def s17(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where(~F.col("has_category")).select("row_no", "derived_category", X.first_sentence(F.coalesce("text", F.lit(""))).alias("l0"))


@query("s18_backfill", f"{MEM} select row_no, memory_category, tier, state, source from mem where (j->>'$.memory_category') is distinct from memory_category or (j->>'$.tier') is distinct from tier or (j->>'$.state') is distinct from state or (j->>'$.source') is distinct from source")
def s18(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    raw = F.from_json("metadata", "map<string,string>")
    differs = [~raw[c].eqNullSafe(F.col(c)) for c in ("memory_category", "tier", "state", "source")]
    return m.where(differs[0] | differs[1] | differs[2] | differs[3]).select("row_no", "memory_category", "tier", "state", "source")


@query("s25_plaintext_turns", r"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as n, unnest(string_split(text, chr(10))) as line from documents where text is not null),
p as (select *, regexp_extract(line, '(?i)^(User|Human|Assistant|AI|System):\s*', 1) as pre from l), t as (select *, sum((pre <> '')::int) over (partition by doc_id order by n) as turn from p),
g as (select doc_id, turn, max(case when pre <> '' then lower(pre) end) as role, regexp_replace(string_agg(case when pre <> '' then trim(regexp_replace(line, '(?i)^(User|Human|Assistant|AI|System):\s*', '')) else line end, chr(10) order by n), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as content from t where turn > 0 group by 1, 2)
select doc_id, case when role in ('user', 'human') then 'user' when role in ('assistant', 'ai') then 'assistant' else 'system' end as role, content from g where content <> ''""")
def s25(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("content"))
    return plaintext_turns(docs).select(F.col("conv_id").alias("doc_id"), "role", "content")


@query("w06_dialogue_pairs", f"""{MEM}, m as (select row_no, scope, timestamp_ms, category from mem), p as (select row_no, lead(row_no) over w as next_row, row_number() over w as n from m window w as (partition by scope order by timestamp_ms, row_no)) select row_no, next_row from p where n % 2 = 1 and next_row is not null""")
def w06(spark: SparkSession, d: str) -> DataFrame:
    m = place_in_group(smart(spark, d).select("row_no", "scope", "timestamp_ms"), ["scope"], ["timestamp_ms", "row_no"], "n", "at")
    after = m.where("n % 2 = 0").select((F.col("at") - 1).alias("at"), F.col("row_no").alias("next_row"))
    return m.where("n % 2 = 1").join(after, "at").select("row_no", "next_row")


@query("j05_fact_key_conflicts", f"""{MEM}, a as (select row_no, scope, fact_key, lower(trim(t)) as tx from mem where fact_key is not null), k as (select scope, fact_key, min(row_no) as first_row, arg_min(tx, row_no) as first_tx from a group by 1, 2)
select a.row_no, first_row, case when a.tx = first_tx then 'duplicate' else 'conflict' end as kind from a join k using (scope, fact_key) where a.row_no <> first_row""")
def j05(spark: SparkSession, d: str) -> DataFrame:
    a = smart(spark, d).where("fact_key is not null").select("row_no", "scope", "fact_key", F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("tx"))
    k = a.groupBy("scope", "fact_key").agg(F.min(F.struct("row_no", "tx")).alias("f"), F.count(F.lit(1)).alias("n"))
    both = X.join_groups(a, k, ["scope", "fact_key"], "n").where("row_no != f.row_no")
    return both.select("row_no", F.col("f.row_no").alias("first_row"), F.when(F.col("tx") == F.col("f.tx"), "duplicate").otherwise("conflict").alias("kind"))


LIVE = "l as (select row_no, scope, memory_category, vector::double[] as v, importance, access_count, t, fact_key from mem where (raw_state is null or raw_state not in ('archived', 'superseded')) and vector is not null and list_dot_product(vector::double[], vector::double[]) > 0)"


@query("j06_similar_pairs", f"{MEM}, {LIVE}, p as (select a.row_no as a, b.row_no as b, round(1 / (2 - list_cosine_similarity(a.v, b.v)), 9) as score from l a join l b on a.scope = b.scope and a.memory_category = b.memory_category and a.row_no < b.row_no), d as (select min(row_no) as rep, scope, memory_category, v, list(row_no) as rows from l group by 2, 3, 4), c as (select rep, unnest(rows) as row_no from d) select a, b, round(score, 6) as score from p where score >= 0.82 and ((a in (select rep from d) and b in (select rep from d)) or (a, b) in (select rep, row_no from c))")
def j06(spark: SparkSession, d: str) -> DataFrame:
    live = smart(spark, d).where(F.col("raw_state").isNull() | ~F.col("raw_state").isin("archived", "superseded"))
    return similar_pairs(live).select("a", "b", F.round("score", 6).alias("score"))


@query("plan_p10_consolidation_plan")
def consolidation_plan(spark: SparkSession, d: str) -> DataFrame:
    return consolidation(smart(spark, d))


@query("j07_conflict_pairs")
def j07(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    return conflicts(similar_pairs(m, 0.7), m)


@query("j17_conflict_links", f"""{MEM}, r as (select id, e->>'$.targetId' as target, 'contradicts' as kind from (select id, unnest(case when json_type(j->'$.relations') = 'ARRAY' then (j->'$.relations')::json[] else []::json[] end) as e from mem) where e->>'$.type' = 'contradicts' and (e->>'$.targetId') is not null)
select distinct id, target, kind from (select * from r union all select id, supersedes, 'supersedes' from mem where supersedes is not null union all select superseded_by, id, 'supersedes' from mem where superseded_by is not null)""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    raw = F.from_json("metadata", "map<string,string>")["relations"]
    rel = F.when(F.col("metadata").rlike(r'"relations"\s*:\s*\['), F.from_json(raw, "array<struct<type:string,targetId:string>>"))
    r = m.select("id", F.inline(rel)).where("type = 'contradicts' and targetId is not null").select("id", F.col("targetId").alias("target"), F.lit("contradicts").alias("kind"))
    s = m.where("supersedes is not null").select("id", F.col("supersedes").alias("target"), F.lit("supersedes").alias("kind"))
    b = m.where("superseded_by is not null").select(F.col("superseded_by").alias("id"), F.col("id").alias("target"), F.lit("supersedes").alias("kind"))
    return r.unionByName(s).unionByName(b).distinct()


@query("j18_resume", f"{MEM} select scope, arg_max(row_no, (timestamp_ms, row_no)) as row_no from mem where source = 'session-summary' group by 1")
def j18(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where("source = 'session-summary'").groupBy("scope").agg(F.max_by("row_no", F.struct("timestamp_ms", "row_no")).alias("row_no"))


@query("plan_p17_supersede", f"""{MEM}, v as (select row_no, scope, fact_key, valid_from, lead(valid_from) over (partition by scope, fact_key order by valid_from, row_no) as closed_at from mem where fact_key is not null) select row_no, closed_at from v where closed_at is not null""")
def p17(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d).where("fact_key is not null").select("row_no", "scope", "fact_key", "valid_from")
    return with_neighbour(m, ["scope", "fact_key"], ["valid_from", "row_no"], {"valid_from": "closed_at"}).where("closed_at is not null").select("row_no", "closed_at")


@query("plan_p22_promote", f"{MEM} select row_no, 'confirmed' as state, case when memory_layer = 'archive' then 'durable' else memory_layer end as memory_layer from mem where state = 'pending' and confidence >= 0.8")
def p22(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where("state = 'pending' and confidence >= 0.8").select("row_no", F.lit("confirmed").alias("state"), F.when(F.col("memory_layer") == "archive", "durable").otherwise(F.col("memory_layer")).alias("memory_layer"))


@query("x08_entities", r"""with c as (select row_no, list_distinct(list_concat(regexp_extract_all(text, '["`]([^"`]{2,})["`]', 1), regexp_extract_all(text, '(\b[A-Z][a-zA-Z]+(?:[ -][A-Z][a-zA-Z]+)*\b)', 1))) as e from incoming_memories where text is not null) select row_no, unnest(e) as entity from c""")
def x08(spark: SparkSession, d: str) -> DataFrame:
    return incoming(spark, d).where("text is not null").select("row_no", F.explode(X.entity_candidates(F.col("text"))).alias("entity"))


@query("a16_entity_frequency", r"""with c as (select unnest(regexp_extract_all(text, '(\b[A-Z][a-zA-Z]+(?:[ -][A-Z][a-zA-Z]+)*\b)', 1)) as entity from memories) select entity, count(*) as n from c group by 1 order by n desc, length(entity) desc, entity limit 20""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "memories").select(F.explode(F.regexp_extract_all("text", F.lit(r"((?<![A-Za-z0-9_])[A-Z][a-zA-Z]+(?:[ -][A-Z][a-zA-Z]+)*(?![A-Za-z0-9_]))"), 1)).alias("entity"))
    return e.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc(F.length("entity")), "entity").limit(20)


CATS = " ".join(f"when regexp_matches(lower(text), {X._lit(p)}) then '{n}'" for n, p in X.CATEGORY_WORDS.items())


@query("x11_detect_category", f"select row_no, case {CATS} else 'other' end as category from incoming_memories where text is not null")
def x11(spark: SparkSession, d: str) -> DataFrame:
    return incoming(spark, d).where("text is not null").select("row_no", X.storage_category(F.col("text")).alias("category"))


SIGS = " ".join(f"when regexp_matches(lower(s), {X._lit(p)}) then '{n}'" for n, p in X.SIGNALS.items())


@query("x10_signals", rf"""with s as (select doc_id, unnest(regexp_split_to_array(text, '[.!?。！？\n]+')) as s from documents where text is not null), c as (select doc_id, regexp_replace(s, '^\s+|\s+$', '', 'g') as s from s) select doc_id, case {SIGS} end as kind, count(*) as n from c where length(s) > 15 and case {SIGS} end is not null group by 1, 2""")
def x10(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", r"[.!?。！？\n]+")).alias("s")).withColumn("s", F.regexp_replace("s", r"^\s+|\s+$", ""))
    return s.where(F.length("s") > 15).select("doc_id", X.signal(F.col("s")).alias("kind")).where("kind is not null").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


_SEC = X._lit(X.SECRETS)


@query("x18_redact", rf"select row_no, regexp_replace(regexp_replace(text, 'Bearer\s+[A-Za-z0-9\-._~+/]+=*', 'Bearer [REDACTED]', 'g'), {_SEC}, '[REDACTED]', 'g') as text from memories where text is not null")
def x18(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memories").where("text is not null").select("row_no", X.redact_secrets(F.col("text")).alias("text"))


@query("x18_error_signal", f"select doc_id, regexp_matches(lower(text), {X._lit(X.ERROR_SIGNAL)}) as has_error from documents where text is not null")
def x18b(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", X.has_error(F.col("text")).alias("has_error"))


@query("x19_inline", r"select row_no, substr(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(text, '[\r\n]+', ' ', 'g'), '</?[a-zA-Z][^>]*>', '', 'g'), '<', '＜'), '>', '＞'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 300) as line from memories where text is not null")
def x19(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memories").where("text is not null").select("row_no", X.inline(F.col("text")).alias("line"))


@query("x22_tokens", "select source, sum(ceil(length(text) / 4))::bigint as tokens from documents where text is not null group by 1")
def x22(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").groupBy("source").agg(F.sum(X.token_estimate(F.col("text"))).cast("bigint").alias("tokens"))


@query("x14_tokens", r"select row_no, len(regexp_extract_all(regexp_replace(lower(text), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}]+')) as n from incoming_memories where text is not null")
def x14(spark: SparkSession, d: str) -> DataFrame:
    apart = F.regexp_replace(F.lower("text"), r"(\p{IsHan})", " $1 ")
    return incoming(spark, d).where("text is not null").select("row_no", F.size(F.regexp_extract_all(apart, F.lit(r"([\p{L}\p{N}]+)"), 1)).cast("bigint").alias("n"))


@query("u04_term_overlap", r"""with w as (select i.row_no, list_distinct(regexp_extract_all(lower(i.text), '[\p{L}\p{N}]+')) as a, list_distinct(regexp_extract_all(lower(m.text), '[\p{L}\p{N}]+')) as b from incoming_memories i join (select id, min(row_no) as row_no from memories group by 1) f on f.id = i.id join memories m on m.row_no = f.row_no where i.text is not null and m.text is not null)
select row_no, len(list_intersect(a, b)) as shared from w""")
def u04(spark: SparkSession, d: str) -> DataFrame:
    first = read_table(spark, d, "memories").groupBy("id").agg(F.min_by("text", "row_no").alias("other"))
    both = incoming(spark, d).join(first, "id").where("text is not null and other is not null")
    return both.select("row_no", F.size(F.array_intersect(F.array_distinct(words(F.col("text"))), F.array_distinct(words(F.col("other"))))).cast("bigint").alias("shared"))


@query("d01_temporal")
def d01(spark: SparkSession, d: str) -> DataFrame:
    q = incoming(spark, d).where("text is not null").select("row_no", "text")
    return with_temporal(q, "text", datetime.fromtimestamp(NOW / 1000, UTC)).where("after_ms is not null or before_ms is not null")


@query("f18_not_injected", f"{MEM} select row_no from mem where id not in (select source_memory_id from kg_triples where source_memory_id is not null)")
def f18(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).join(read_table(spark, d, "kg_triples").where("source_memory_id is not null").select(F.col("source_memory_id").alias("id")), "id", "left_anti").select("row_no")


@query("f08_temporal_filter", f"{MEM} select row_no from mem where timestamp_ms >= 1719792000000 and timestamp_ms < 1735689600000")
def f08(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where("timestamp_ms >= 1719792000000 and timestamp_ms < 1735689600000").select("row_no")


@query("r01_access_windows", "select user_id, time_bucket(interval 5 seconds, ts) as start, count(*) as accesses from events where event_type = 'click' group by 1, 2")
def r01(spark: SparkSession, d: str) -> DataFrame:
    return jobs.access_counts(read_table(spark, d, "events").where("event_type = 'click'"))


@query("r07_rate_windows", "select user_id, time_bucket(interval 1 minute, ts) as start, count(*) as n, count(*) > 100 as limited from events group by 1, 2")
def r07(spark: SparkSession, d: str) -> DataFrame:
    return jobs.rates(read_table(spark, d, "events"))


@query("r05_error_signals", "select user_id, count(distinct event_type || '|' || (props::json->>'$.k')) as signals from events where event_type = 'error' group by 1")
def r05(spark: SparkSession, d: str) -> DataFrame:
    return jobs.signals(read_table(spark, d, "events")).groupBy("user_id").agg(F.count(F.lit(1)).alias("signals"))


@query("r02_turn_history", "with t as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as turn, props::json->>'$.k' as item from events), l as (select *, lag(turn) over (partition by user_id, item order by turn) as before from t) select event_id, before is not null and turn - before < 8 as hidden from l")
def r02(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").alias("item"))
    t = with_neighbour(place_in_group(e, ["user_id"], ["ts", "event_id"], "turn"), ["user_id", "item"], ["turn"], {"turn": "before"}, -1)
    return t.select("event_id", (F.col("before").isNotNull() & (F.col("turn") - F.col("before") < 8)).alias("hidden"))


@query("r_sessions", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as sid from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, sid")
def r_sessions(spark: SparkSession, d: str) -> DataFrame:
    return jobs.sessions(read_table(spark, d, "events")).select("user_id", "start", "n")
