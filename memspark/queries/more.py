"""Queries on gates, reflections, admission, feedback, budgets, aliases, layers and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.functions.embed import backfill, embed_column, mean_vector
from memspark.functions.norm import scope_key, words
from memspark.metadata import SEMANTIC_TO_STORAGE, STORAGE_TO_SEMANTIC
from memspark.operators import admission as A
from memspark.operators.ordered import place_in_group
from memspark.operators.search import vector_hits
from memspark.queries.base import MEM, NOW, query, smart
from memspark.queries.retrieval import Q, asked, knn_sql
from memspark.session import read_table

#: Lines that try to give instructions to whoever reads them.
UNSAFE = (
    r"(?i)^\s*(?:(?:next|this)\s+run\s+)?(?:ignore|disregard|forget|override|bypass)\b.{0,80}\b(?:instructions?|guardrails?|policy|developer|system)\b|\b(?:reveal|print|dump|show|output)\b.{0,80}\b(?:system prompt|developer prompt|hidden prompt|hidden instructions?|full prompt|prompt verbatim|secrets?|keys?|tokens?)\b"
    r"|<\s*/?\s*(?:system|assistant|user|tool|developer|inherited-rules|derived-focus)\b[^>]*>|^(?:system|assistant|user|developer|tool)\s*:"
)
LINE = lambda c: rf"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("f03_accessible_scopes", """with a as (select distinct case when scope is null or trim(scope) = '' then 'global' else lower(trim(scope)) end as scope from memories), g as (select scope as agent from a where scope like 'agent:%')
select agent, scope from g, a where scope = 'global' or scope = agent or scope = 'reflection:' || agent""")
def f03(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "memories").select(scope_key(F.col("scope")).alias("scope")).distinct()
    g = a.where("scope like 'agent:%'").select(F.col("scope").alias("agent"))
    allowed = g.select("agent", F.explode(F.array(F.lit("global"), F.col("agent"), F.concat(F.lit("reflection:"), F.col("agent")))).alias("scope"))
    return allowed.join(a, "scope", "left_semi").select("agent", "scope")


@query("f06_category_after_topk", f"with {Q}, h as (select query_no, row_no from {knn_sql('memories', 'vector', 'vector', 20)}) select query_no, row_no from h join memories m using (row_no) where m.category = 'preference'")
def f06(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memories")
    return vector_hits(m, asked(spark, d), 20).join(m.select("row_no", "category"), "row_no").where("category = 'preference'").select("query_no", "row_no")


PROTO = "proto as (select row_no, vector from memories where category = 'other')"


@query("f11_noise_prototypes", f"with {Q}, {PROTO}, h as (select query_no, max(round(list_cosine_similarity(vector::double[], qv), 9)) as sim from proto, qs where vector is not null and list_dot_product(vector::double[], vector::double[]) > 0 and qv is not null and list_dot_product(qv, qv) > 0 group by 1) select query_no, round(sim, 6) as sim, sim >= 0.82 as is_noise from h")
def f11(spark: SparkSession, d: str) -> DataFrame:
    bank = read_table(spark, d, "memories").where("category = 'other'")
    return vector_hits(bank, asked(spark, d), 1).select("query_no", F.round("raw", 6).alias("sim"), (F.col("raw") >= 0.82).alias("is_noise"))


@query("f20_injectable_lines", f"with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null), n as (select doc_id, {LINE('line')} as line from l) select doc_id, count(*) as unsafe from n where line <> '' and regexp_matches(line, {X._lit(UNSAFE)}) group by 1")
def f20(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    n = lines.select("doc_id", F.regexp_replace(F.regexp_replace("line", r"\s+", " "), r"^\s+|\s+$", "").alias("line"))
    return n.where(F.col("line").rlike(UNSAFE) & (F.col("line") != "")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("unsafe"))


TRIGGERS = r"(?i)zapamatuj si|pamatuj|remember|preferuji|radši|nechci|prefer|rozhodli jsme|budeme používat|\b(we )?decided\b|we'?ll use|we will use|switch(ed)? to|migrate(d)? to|going forward|from now on|\+\d{10,}|[\w.-]+@[\w.-]+\.\w+|my\s+\w+\s+is|is\s+my|i (like|prefer|hate|love|want|need|care)|always|never|important|記住|记住|偏好|喜好|喜歡|喜欢|討厭|讨厌|習慣|习惯|決定|决定|改用|換成|换成|我的\S+是|叫我|稱呼|称呼|總是|总是|從不|从不|一直|每次都|重要|關鍵|关键|注意|千萬別|千万别"
EXCLUDED = r"(?i)\b(memory_store|memory_recall|memory_forget|memory_update)\b|\b(delete|remove|forget|purge|cleanup|clean up|clear)\b.*\b(memory|memories|entry|entries)\b|\b(memory|memories)\b.*\b(delete|remove|forget|purge|cleanup|clean up|clear)\b"


@query("f22_capture_gate", rf"with s as (select row_no, regexp_replace(text, '^\s+|\s+$', '', 'g') as s from memories where text is not null) select row_no, length(s) between case when regexp_matches(s, '{X.CJK}') then 4 else 10 end and 500 and not regexp_matches(s, {X._lit(EXCLUDED)}) and regexp_matches(s, {X._lit(TRIGGERS)}) as capture from s")
def f22(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "memories").where("text is not null").select("row_no", F.regexp_replace("text", r"^\s+|\s+$", "").alias("s"))
    fits = (F.length("s") >= F.when(F.col("s").rlike(X.CJK), 4).otherwise(10)) & (F.length("s") <= 500)
    return s.select("row_no", (fits & ~F.col("s").rlike(EXCLUDED) & F.col("s").rlike(TRIGGERS)).alias("capture"))


_ENVELOPE = "<relevant-memories>\n- one\n</relevant-memories>\nSender (untrusted metadata):\n```json\n{\"a\": 1}\n```\n@bot "
_SQL_STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query("f23_cleanup", rf"select doc_id, length(regexp_replace({_SQL_STRIP('text')}, '\n{{3,}}', chr(10) || chr(10), 'g'))::bigint as n, md5(regexp_replace({_SQL_STRIP('text')}, '\n{{3,}}', chr(10) || chr(10), 'g')) as digest from documents where text is not null")
def f23(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a message in an envelope: what is left is the document."""
    t = X.without_envelope(F.concat(F.lit(_ENVELOPE), "text"))
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.length(t).cast("bigint").alias("n"), F.md5(t).alias("digest"))


@query("a07_admission_stats", f"{MEM} select source, count(*) as total, count(*) filter (where state = 'confirmed') as admitted, count(*) filter (where state = 'archived') as archived, count(*) filter (where timestamp_ms > {NOW} - 30 * 86400000::bigint) as last_30d, max(timestamp_ms) as latest from mem group by 1")
def a07(spark: SparkSession, d: str) -> DataFrame:
    st = F.col("state")
    return smart(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(st == "confirmed").alias("admitted"), F.count_if(st == "archived").alias("archived"), F.count_if(F.col("timestamp_ms") > NOW - 30 * 86400000).alias("last_30d"), F.max("timestamp_ms").alias("latest"))


LOGIT = f"1 / (1 + exp(0.22 * (greatest(0.0, ({NOW} - timestamp_ms) / 86400000.0) - 120)))"


@query("a11_reflection_lines", f"{MEM}, l as (select {LINE('lower(unnest(string_split(t, chr(10))))')} as k, unnest(string_split(t, chr(10))) as line, timestamp_ms, row_no, {LOGIT} * confidence as s from mem where source = 'reflection'), g as (select k, round(sum(s), 9) as score, max(timestamp_ms) as latest from l where k <> '' group by 1) select k, round(score, 6) as score, latest from g order by round(score, 6) desc, latest desc, k limit 10")
def a11(spark: SparkSession, d: str) -> DataFrame:
    age = F.greatest(F.lit(0.0), (F.lit(NOW) - F.col("timestamp_ms")) / F.lit(86_400_000.0))
    lines = smart(spark, d).where("source = 'reflection'").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"), "timestamp_ms", (1 / (1 + F.exp(0.22 * (age - 120))) * F.col("confidence")).alias("s"))
    key = F.regexp_replace(F.regexp_replace(F.lower("line"), r"\s+", " "), r"^\s+|\s+$", "")
    g = lines.withColumn("k", key).where("k != ''").groupBy("k").agg(F.round(F.sum("s"), 9).alias("score"), F.max("timestamp_ms").alias("latest"))
    return g.orderBy(F.desc(F.round("score", 6)), F.desc("latest"), "k").limit(10).select("k", F.round("score", 6).alias("score"), "latest")


@query("a13_mean_vector", "with u as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), a as (select label, i, avg(x) as x from u group by 1, 2) select label, count(*) as dim, round(sum(x), 6) as total from a group by 1")
def a13(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("dim"), F.round(F.sum("x"), 6).alias("total"))


@query("plan_p21_long_text_embedding")
def p21(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([\s\S]{1,1000})"), 1)).alias("chunk"))
    return mean_vector(t.select("doc_id", embed_column(F.col("chunk")).alias("vector")), "doc_id")


@query("s19_vector_backfill")
def s19(spark: SparkSession, d: str) -> DataFrame:
    return backfill(read_table(spark, d, "memories").select("row_no", "text", "vector"), "vector", F.col("text"))


@query("a22_token_f1", r"""with p as (select i.row_no, regexp_extract_all(lower(coalesce(i.text, '')), '[A-Za-z0-9_]+') as a, regexp_extract_all(lower(coalesce(m.text, '')), '[A-Za-z0-9_]+') as b, i.category from incoming_memories i join (select id, min(row_no) as row_no from memories group by 1) f on f.id = i.id join memories m on m.row_no = f.row_no),
w as (select category, case when len(a) = 0 and len(b) = 0 then 1.0 when len(a) = 0 or len(b) = 0 then 0.0 else 2.0 * len(list_intersect(list_distinct(a), list_distinct(b))) / (len(a) + len(b)) end as f from p)
select category, count(*) as n, round(avg(f), 6) as f1, round(avg(case when f >= 0.5 then 1.0 else 0.0 end), 6) as acc from w group by 1""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    """Words in both texts, each once, against all words of either; the memory of the same id stands for the answer."""
    tokens = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([A-Za-z0-9_]+)"), 1)
    first = read_table(spark, d, "memories").groupBy("id").agg(F.min(F.struct("row_no", "text"))["text"].alias("other"))
    w = read_table(spark, d, "incoming_memories").join(first, "id").select("category", tokens(F.col("text")).alias("a"), tokens(F.col("other")).alias("b"))
    a, b = F.size("a"), F.size("b")
    f1 = F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect("a", "b")) / (a + b))
    return w.withColumn("f", f1).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f"), 6).alias("f1"), F.round(F.avg((F.col("f") >= 0.5).cast("double")), 6).alias("acc"))


@query("j03_ghost_validation", "select k.id from kg_triples k where source_memory_id in (select id from memories where id is not null)")
def j03(spark: SparkSession, d: str) -> DataFrame:
    live = read_table(spark, d, "memories").select(F.col("id").alias("source_memory_id"))
    return read_table(spark, d, "kg_triples").join(live, "source_memory_id", "left_semi").select("id")


@query("w03_injection_budget", f"{MEM}, r as (select scope, row_no, length(t) as n, row_number() over w as place, sum(length(t)) over w as total from mem window w as (partition by scope order by importance desc, row_no)) select scope, row_no, least(n, 600 - (total - n))::bigint as taken from r where place <= 3 and total - n < 600")
def w03(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("scope").orderBy(F.desc("importance"), "row_no")
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    top = smart(spark, d).withColumns({"n": n, "place": F.row_number().over(w)}).where("place <= 3")
    total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("total", total).where("total - n < 600").select("scope", "row_no", F.least(F.col("n"), 600 - (F.col("total") - F.col("n"))).alias("taken"))


@query("w05_keep_last", "with r as (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events where event_type = 'view') select event_id, place > 5 as cleared from r")
def w05(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").where("event_type = 'view'").select("event_id", "user_id", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), (-F.col("event_id")).alias("e"))
    return place_in_group(e, ["user_id"], ["t", "e"]).select("event_id", (F.col("place") > 5).alias("cleared"))


@query("w09_access_gap", "select user_id, round(case when count(*) > 1 then (epoch(max(ts)) - epoch(min(ts))) / (count(*) - 1) else 0 end, 3) as gap_s from events where event_type = 'click' group by 1")
def w09(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    span = (F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))) / 1e6
    n = F.count(F.lit(1))
    return read_table(spark, d, "events").where("event_type = 'click'").groupBy("user_id").agg(F.round(F.when(n > 1, span / (n - 1)).otherwise(0.0), 3).alias("gap_s"))


@query("u02_distinct", f"{MEM} select distinct scope, memory_category, tier from mem")
def u02(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).select("scope", "memory_category", "tier").distinct()


@query("u03_difference", "select id from incoming_memories except select id from memories")
def u03(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "incoming_memories").select("id").subtract(read_table(spark, d, "memories").select("id"))


@query("u05_overlay", f"{MEM} select row_no, coalesce(j->>'$.tier', 'working') as tier, coalesce(j->>'$.source', 'legacy') as source from mem")
def u05(spark: SparkSession, d: str) -> DataFrame:
    base = F.create_map(F.lit("tier"), F.lit("working"), F.lit("source"), F.lit("legacy"))
    own = F.map_filter(F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: k.isin("tier", "source") & v.isNotNull())
    laid = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)
    return smart(spark, d).select("row_no", laid["tier"].alias("tier"), laid["source"].alias("source"))


@query("m09_rerank_cosine", f"with {Q}, h as (select query_no, row_no, raw from {knn_sql('memories', 'vector', 'vector', 10)}) select query_no, row_no, round(greatest(0.0, least(1.0, 0.7 / (1 + (1 - raw)) + 0.3 * raw)), 6) as score from h")
def m09(spark: SparkSession, d: str) -> DataFrame:
    h = vector_hits(read_table(spark, d, "memories"), asked(spark, d), 10)
    return h.select("query_no", "row_no", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * F.col("score") + 0.3 * F.col("raw"))), 6).alias("score"))


@query("m24_feedback_ema", "with e as (select user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as back, case when event_type = 'purchase' then 1.0 else 0.0 end as signal, count(*) over (partition by user_id) as n from events where event_type in ('purchase', 'error')) select user_id, round(sum(0.15::double * signal * pow(0.85::double, back - 1)) + 0.5::double * pow(0.85::double, any_value(n)), 6) as weight from e group by 1")
def m24(spark: SparkSession, d: str) -> DataFrame:
    # the running average in closed form: a signal's weight falls by 0.85 with each later one, so no fold is needed
    e = read_table(spark, d, "events").where("event_type in ('purchase', 'error')").select("user_id", "event_type", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), (-F.col("event_id")).alias("e"))
    part = 0.15 * (F.col("event_type") == "purchase").cast("double") * F.pow(F.lit(0.85), F.col("back") - 1)
    return place_in_group(e, ["user_id"], ["t", "e"], "back").groupBy("user_id").agg(F.round(F.sum(part) + 0.5 * F.pow(F.lit(0.85), F.count(F.lit(1))), 6).alias("weight"))


PRIOR = "case memory_category " + " ".join(f"when '{k}' then {v}" for k, v in A.PRESETS["balanced"]["priors"].items()) + " else 0.5 end"


@query("m28_admission", f"""{MEM}, {Q}, h as (select query_no, max(raw) as sim, max(m.timestamp_ms) as latest from {knn_sql('mem', 'vector', 'vector', 8)} h join mem m using (row_no) group by 1), s as (select query_no, greatest(0.0, sim) as sim, latest, case qcategory when 'preference' then 'preferences' when 'entity' then 'entities' when 'decision' then 'events' when 'fact' then 'cases' else 'patterns' end as memory_category from h join qs using (query_no)),
t as (select query_no, sim, 0.1::double * 0.5 + 0.1 * 1.0 + 0.1 * (1 - sim) + 0.1 * (1 - exp(-ln(2) / 14 * greatest(0.0, ({NOW} - latest) / 86400000.0))) + 0.6 * {PRIOR} as score from s)
select query_no, round(score, 6) as score, case when score < 0.45 then 'reject' when score >= 0.6 and sim < 0.55 then 'add' else 'update_or_merge' end as decision from t""")
def m28(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    h = vector_hits(m, asked(spark, d), 8).join(m.select("row_no", "timestamp_ms"), "row_no").groupBy("query_no").agg(F.greatest(F.lit(0.0), F.max("raw")).alias("sim"), F.max("timestamp_ms").alias("latest"))
    h = h.join(asked(spark, d).select("query_no", "category"), "query_no")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in (STORAGE_TO_SEMANTIC | {"fact": "cases"}).items() for x in kv])[F.col("category")], F.lit("patterns"))
    gap = A.recency_gap((F.lit(NOW) - F.col("latest")) / F.lit(86_400_000.0), 14.0)
    score = A.admission_score(F.lit(A.UTILITY_UNKNOWN), F.lit(1.0), 1 - F.col("sim"), gap, kind)
    return h.select("query_no", F.round(score, 6).alias("score"), A.admission_decision(score, F.col("sim")).alias("decision"))


@query("m27_support")
def m27(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    hits = vector_hits(m, asked(spark, d), 1).join(m.select("row_no", F.col("l2").alias("other")), "row_no").join(asked(spark, d).select("query_no", "text"), "query_no")
    return hits.select("query_no", "row_no", F.round(A.support_column(F.col("text"), F.col("other")), 6).alias("support"))


@query("m30_highlight", rf"""with {Q}, h as (select query_no, row_no, 1 / (1 + (1 - raw)) as s from {knn_sql('memories', 'vector', 'vector', 5)}), w as (select query_no, h.row_no, s, list_distinct(regexp_extract_all(lower(qtext), '[\p{{L}}\p{{N}}]+')) as a, list_distinct(regexp_extract_all(lower(m.text), '[\p{{L}}\p{{N}}]+')) as b from h join qs using (query_no) join memories m on m.row_no = h.row_no)
select query_no, row_no, round(0.6 * s + 0.4 * len(list_intersect(a, b)) / greatest(len(a), len(b), 1), 6) as relevance from w""")
def m30(spark: SparkSession, d: str) -> DataFrame:
    m, q = read_table(spark, d, "memories"), asked(spark, d)
    h = vector_hits(m, q, 5).join(m.select("row_no", F.array_distinct(words(F.col("text"))).alias("b")), "row_no").join(q.select("query_no", F.array_distinct(words(F.col("text"))).alias("a")), "query_no")
    return h.select("query_no", "row_no", F.round(0.6 * F.col("score") + 0.4 * F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.size("b"), F.lit(1)), 6).alias("relevance"))


@query("x03_fact_key", f"{MEM} select row_no, fact_key from mem where memory_category in ('preferences', 'entities')")
def x03(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where("memory_category in ('preferences', 'entities')").select("row_no", "fact_key")


AL = "case lower(trim(w)) " + " ".join(f"when '{k}' then '{v}'" for k, v in X.ALIASES.items()) + " else lower(trim(w)) end"


@query("x05_aliases", rf"with t as (select unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) as w from documents) select {AL} as name, count(*) as n from t group by 1")
def x05(spark: SparkSession, d: str) -> DataFrame:
    w = read_table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return w.groupBy(X.alias_of(F.col("w")).alias("name")).agg(F.sum("c").alias("n"))


@query("x16_chunks")
def x16(spark: SparkSession, d: str) -> DataFrame:
    from memspark.functions.chunker import chunk_rows

    return chunk_rows(read_table(spark, d, "documents"), "doc_id", "text", 1000, 100, 200)


@query("x21_language", r"select doc_id, case when len(regexp_extract_all(text, '\p{Han}')) > 0.3 * greatest(length(regexp_replace(text, '\s', '', 'g')), 1) then 'zh' when len(regexp_extract_all(lower(text), '\b(der|die|das|und|ist)\b')) > len(regexp_extract_all(lower(text), '\b(the|and|of|this|that)\b')) then 'de' else 'other' end as guess from documents where text is not null")
def x21(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    han = F.regexp_count(t, F.lit(r"\p{IsHan}")) > 0.3 * F.greatest(F.length(F.regexp_replace(t, r"\s", "")), F.lit(1))
    n = lambda p: F.regexp_count(F.lower(t), F.lit(rf"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])"))
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.when(han, "zh").when(n("der|die|das|und|ist") > n("the|and|of|this|that"), "de").otherwise("other").alias("guess"))


BACK = "case memory_category " + " ".join(f"when '{k}' then '{v}'" for k, v in SEMANTIC_TO_STORAGE.items()) + " else 'other' end"


@query("x25_category_maps", f"{MEM} select row_no, derived_category, {BACK} as storage from mem")
def x25(spark: SparkSession, d: str) -> DataFrame:
    back = F.create_map(*[F.lit(x) for kv in SEMANTIC_TO_STORAGE.items() for x in kv])
    return smart(spark, d).select("row_no", "derived_category", F.coalesce(back[F.col("memory_category")], F.lit("other")).alias("storage"))


@query("plan_p11_lifecycle", f"{MEM}, {Q}, h as (select distinct row_no from {knn_sql('mem', 'vector', 'vector', 5)}) select row_no, access_count + 1 as access_count, {NOW} as last_accessed_at from mem where row_no in (select row_no from h)")
def p11(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    return m.join(vector_hits(m, asked(spark, d), 5).select("row_no").distinct(), "row_no", "left_semi").select("row_no", (F.col("access_count") + 1).alias("access_count"), F.lit(NOW).alias("last_accessed_at"))


@query("plan_p16_checkpoint", f"{MEM} select scope, max(timestamp_ms) as last_ms, count(*) as rows_there from mem where source in ('session-summary', 'manual') group by 1")
def p16(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).where("source in ('session-summary', 'manual')").groupBy("scope").agg(F.max("timestamp_ms").alias("last_ms"), F.count(F.lit(1)).alias("rows_there"))


@query("plan_p18_forget", f"with {Q}, h as (select query_no, row_no, 1 / (1 + (1 - raw)) as s from {knn_sql('memories', 'vector', 'vector', 20)}), u as (select query_no, min(row_no) as row_no from h where s > 0.9 group by 1 having count(*) = 1) select row_no from memories where row_no not in (select row_no from u)")
def p18(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memories")
    one = vector_hits(m, asked(spark, d), 20).where("score > 0.9").groupBy("query_no").agg(F.min("row_no").alias("row_no"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return m.join(one.select("row_no"), "row_no", "left_anti").select("row_no")


@query("plan_p23_provenance", f"{MEM} select row_no, source, j->>'$.source_session' as source_session, supersedes, superseded_by, canonical_id from mem where source = 'auto-capture'")
def p23(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    return m.where("source = 'auto-capture'").select("row_no", "source", F.from_json("metadata", "map<string,string>")["source_session"].alias("source_session"), "supersedes", "superseded_by", "canonical_id")


@query("plan_p26_inherited_rules", f"{MEM}, r as (select scope, row_no, row_number() over (partition by scope order by importance desc, row_no) as place from mem where category = 'reflection') select scope, row_no from r where place <= 6")
def p26(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("scope").orderBy(F.desc("importance"), "row_no")
    return smart(spark, d).where("category = 'reflection'").withColumn("place", F.row_number().over(w)).where("place <= 6").select("scope", "row_no")


@query("r03_session_set", "with e as (select user_id, event_id, props::json->>'$.k' as item, row_number() over (partition by user_id, props::json->>'$.k' order by ts, event_id) as n from events) select event_id from e where n = 1")
def r03(spark: SparkSession, d: str) -> DataFrame:
    item = F.get_json_object("props", "$.k").alias("item")
    e = read_table(spark, d, "events").select("user_id", "event_id", "ts", item)
    return e.groupBy("user_id", "item").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("event_id")


@query("r06_consolidation_trigger", "select time_bucket(interval 1 hour, ts) as hour, count(*) as writes, count(*) >= 50 as due from events where event_type in ('signup', 'purchase') group by 1")
def r06(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").where("event_type in ('signup', 'purchase')").groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("writes"))
    return e.select(F.col("window.start").alias("hour"), "writes", (F.col("writes") >= 50).alias("due"))
