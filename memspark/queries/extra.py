"""Queries on conversation formats, injection, capture, channel rules, lists in metadata, and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.metadata import active_at
from memspark.operators.search import bm25_hits, vector_hits
from memspark.operators.select import char_budget
from memspark.plans.auto_recall import inject, noted
from memspark.plans.recall import LAYERS, RecallConfig, hybrid
from memspark.queries import analytics, maintenance
from memspark.queries.base import MEM, NOW, SQL, query, smart
from memspark.queries.retrieval import Q, asked, bm25_sql, fused_sql, hits_sql, knn_sql, stages_sql
from memspark.session import read_table
from memspark.sources.conversations import detect_format, json_turns, plaintext_turns

TURNS = SQL["s25_plaintext_turns"]
FUSED = fused_sql({"vector": 0.35, "l0": 0.15, "l1": 0.10, "l2": 0.10, "bm25": 0.30})


def turns(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("content"))
    return plaintext_turns(docs)


def rebuilt(spark: SparkSession, d: str, message, wrap) -> DataFrame:
    """Turns of user and assistant written as JSON conversations and read back; a conversation is one row."""
    t = turns(spark, d).where("role != 'system'")
    conv = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("t"))
    return json_turns(conv.select("conv_id", wrap(F.transform("t", message)).alias("content"))).select(F.col("conv_id").alias("doc_id"), "role", "content")


BOTH = f"select doc_id, role, content from ({TURNS}) t where role <> 'system'"


@query("s20_detect_format", r"""select doc_id, case when starts_with(trim(text), '{') and contains(text, chr(10) || '{') and regexp_matches(text, '"(type|message)"\s*:') then 'agent-jsonl' when contains(text, '"chat_messages"') then 'hosted-chat' when contains(text, '"mapping"') then 'message-tree'
when starts_with(trim(text), '[') and regexp_matches(text, '"ts"\s*:') then 'team-chat' when starts_with(trim(text), '{') and regexp_matches(text, '"(type|message)"\s*:') then 'agent-jsonl' else 'plaintext' end as format from documents where text is not null""")
def s20(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", detect_format(F.col("text")).alias("format"))


@query("s21_agent_jsonl", BOTH)
def s21(spark: SparkSession, d: str) -> DataFrame:
    msg = lambda t: F.to_json(F.struct(F.when(t["role"] == "user", "human").otherwise("assistant").alias("type"), F.struct(t["content"].alias("content")).alias("message")))
    return rebuilt(spark, d, msg, lambda a: F.array_join(a, "\n"))


@query("s22_hosted_chat", BOTH)
def s22(spark: SparkSession, d: str) -> DataFrame:
    msg = lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("assistant").alias("sender"), t["content"].alias("text"))
    return rebuilt(spark, d, msg, lambda a: F.to_json(F.struct(a.alias("chat_messages"))))


@query("s23_message_tree", BOTH)
def s23(spark: SparkSession, d: str) -> DataFrame:
    # a chain of messages under a root, each the child of the one before
    def node(t: F.Column) -> F.Column:
        n = t["turn"]
        return F.struct(n.cast("string").alias("key"), F.struct(F.concat(F.lit("k"), n.cast("string")).alias("id"), t["role"].alias("role"), t["content"].alias("content")).alias("value"))

    def wrap(a: F.Column) -> F.Column:
        size = F.size(a)
        entries = F.transform(a, lambda x, i: F.struct(F.concat(F.lit("n"), i.cast("string")).alias("key"), F.struct(F.when(i > 0, F.concat(F.lit("n"), (i - 1).cast("string"))).alias("parent"), F.when(i < size - 1, F.array(F.concat(F.lit("n"), (i + 1).cast("string")))).alias("children"), F.struct(F.struct(x["value"]["role"].alias("role")).alias("author"), F.struct(F.array(x["value"]["content"]).alias("parts")).alias("content")).alias("message")).alias("value")))
        return F.to_json(F.struct(F.map_from_entries(entries).alias("mapping")))

    return rebuilt(spark, d, node, wrap)


@query("s24_team_chat", BOTH)
def s24(spark: SparkSession, d: str) -> DataFrame:
    msg = lambda t: F.struct(t["content"].alias("text"), t["turn"].cast("string").alias("ts"), F.when(t["role"] == "assistant", "bot").alias("bot_id"))
    return rebuilt(spark, d, msg, F.to_json)


@query("s28_last_messages", f"with t as ({TURNS.replace('select doc_id, case when role', 'select doc_id, turn, case when role')}), r as (select *, row_number() over (partition by doc_id order by turn desc) as back from t where role <> 'system') select doc_id, role, content from r where back <= 3")
def s28(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns(spark, d).where("role != 'system'").withColumn("back", F.row_number().over(w)).where("back <= 3").select(F.col("conv_id").alias("doc_id"), "role", X.redact_secrets(F.col("content")).alias("content"))


@query("s32_lesson_lines", rf"with l as (select doc_id, regexp_replace(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') as k from documents where text is not null) select k, count(*) as n, min(doc_id) as first_doc from l where length(k) >= 20 and not regexp_matches(k, '^#|^```|^\$ ') group by 1 having count(*) > 1 order by n desc, k limit 20")
def s32(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    k = F.regexp_replace(F.regexp_replace(F.lower("line"), r"\s+", " "), r"^\s+|\s+$", "")
    g = lines.select("doc_id", k.alias("k")).where((F.length("k") >= 20) & ~F.col("k").rlike(r"^#|^```|^\$ ")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return g.where("n > 1").orderBy(F.desc("n"), "k").limit(20)


@query("f13_min_score", f"{hits_sql()}, {FUSED} select query_no, row_no from fused where fused >= 0.3")
def f13(spark: SparkSession, d: str) -> DataFrame:
    from memspark.operators.search import fuse

    live = smart(spark, d).where(active_at(NOW))
    return fuse(vector_hits(live, asked(spark, d), 20, LAYERS).unionByName(bm25_hits(live, asked(spark, d), 20))).where("fused >= 0.3").select("query_no", "row_no")


@query("f27_reflection_rows", f"{MEM} select row_no, category = 'reflection' or source = 'reflection' as is_reflection from mem")
def f27(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).select("row_no", ((F.col("category") == "reflection") | (F.col("source") == "reflection")).alias("is_reflection"))


@query("j02_channel_sources", f"{hits_sql()} select query_no, row_no, count(*) as channels, max(case when channel = 'bm25' then 1 else 0 end) = 1 as lexical, min(rank) as best_rank from hits group by 1, 2")
def j02(spark: SparkSession, d: str) -> DataFrame:
    live = smart(spark, d).where(active_at(NOW))
    h = vector_hits(live, asked(spark, d), 20, LAYERS).unionByName(bm25_hits(live, asked(spark, d), 20))
    return h.groupBy("query_no", "row_no").agg(F.count(F.lit(1)).alias("channels"), (F.max((F.col("channel") == "bm25").cast("int")) == 1).alias("lexical"), F.min("rank").cast("bigint").alias("best_rank"))


@query("m10_preservation_floor", f"{MEM}, {Q}, {bm25_sql('mem')}, s as (select query_no, row_no, 1 / (1 + exp(-raw / 5)) as b from bm) select query_no, row_no, round(b * case when b >= 0.75 then 0.95 when b >= 0.6 then 0.9 else 0.5 end, 6) as returned_floor, round(b * case when b >= 0.75 then 1.0 when b >= 0.6 then 0.95 else 0.8 end, 6) as unreturned_floor from s")
def m10(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("score")
    h = bm25_hits(smart(spark, d), asked(spark, d), 20)
    return h.select("query_no", "row_no", F.round(b * F.when(b >= 0.75, 0.95).when(b >= 0.6, 0.9).otherwise(0.5), 6).alias("returned_floor"), F.round(b * F.when(b >= 0.75, 1.0).when(b >= 0.6, 0.95).otherwise(0.8), 6).alias("unreturned_floor"))


@query("m07_graph_blend", f"""{MEM}, {Q}, h as (select query_no, row_no, 1 / (1 + (1 - raw)) as s from {knn_sql('mem', 'vector', 'vector', 10)}), g as (select query_no, m.row_no, max(coalesce(k.confidence, 0.0)) as g from qs join kg_triples k on length(trim(k.subject)) >= 3 and contains(lower(qs.qtext), lower(trim(k.subject))) join mem m on m.id = k.source_memory_id group by 1, 2)
select query_no, row_no, round(case when h.s is null then g.g else least(1.0, h.s + 0.2 * coalesce(g.g, 0)) end, 6) as score from h full join g using (query_no, row_no)""")
def m07(spark: SparkSession, d: str) -> DataFrame:
    """Rows that vectors found gain a fifth of their graph score; those only the graph found have that. The graph score
    here is the confidence of a row's triples whose subject the query names."""
    m, q = smart(spark, d), asked(spark, d)
    k = read_table(spark, d, "kg_triples").select(F.lower(F.trim("subject")).alias("subject"), F.col("source_memory_id").alias("id"), F.coalesce("confidence", F.lit(0.0)).alias("c")).where("length(subject) >= 3")
    # a subject meets the queries that have its first three characters, then is looked for as a whole
    threes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - 2, F.lit(1))), lambda i: F.substring(F.col("t"), i, F.lit(3))))
    texts = q.select("query_no", F.lower("text").alias("t")).where("t is not null").select("query_no", "t", F.explode(threes).alias("three"))
    named = k.select("subject").distinct().withColumn("three", F.substring("subject", 1, 3)).join(texts, "three").where(F.contains(F.col("t"), F.col("subject"))).select("query_no", "subject").distinct()
    g = named.join(k, "subject").join(m.select("row_no", "id"), "id").groupBy("query_no", "row_no").agg(F.max("c").alias("g"))
    h = vector_hits(m, q, 10).select("query_no", "row_no", "score").join(g, ["query_no", "row_no"], "full")
    return h.select("query_no", "row_no", F.round(F.when(F.col("score").isNull(), F.col("g")).otherwise(F.least(F.lit(1.0), F.col("score") + 0.2 * F.coalesce("g", F.lit(0.0)))), 6).alias("score"))


@query("n03_capped_lists", f"{MEM}, r as (select row_no, case when json_type(j->'$.relations') = 'ARRAY' then json_array_length(j->'$.relations') else 0 end as n from mem) select row_no, n::bigint as relations, least(n, 16)::bigint as kept from r where n > 0")
def n03(spark: SparkSession, d: str) -> DataFrame:
    raw = F.from_json("metadata", "map<string,string>")["relations"]
    listed = F.when(F.col("metadata").rlike(r'"relations"\s*:\s*\['), F.from_json(raw, "array<string>"))
    m = smart(spark, d).select("row_no", listed.alias("r")).where(F.size("r") > 0)
    return m.select("row_no", F.size("r").cast("bigint").alias("relations"), F.size(F.slice("r", 1, 16)).cast("bigint").alias("kept"))


@query("n05_access_metadata", f"{MEM} select row_no, least(10000, access_count) as access_count from mem")
def n05(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).select("row_no", F.least(F.lit(10000), F.col("access_count")).cast("bigint").alias("access_count"))


@query("n06_support_info", f"{MEM}, s as (select row_no, try_cast(j->>'$.support_info.global_strength' as double) as strength, try_cast(j->>'$.support_info.total_observations' as bigint) as observations from mem) select row_no, round(coalesce(strength, 0.5), 6) as strength, coalesce(observations, 0) as observations from s where strength is not null or observations is not null")
def n06(spark: SparkSession, d: str) -> DataFrame:
    s = F.from_json(F.from_json("metadata", "map<string,string>")["support_info"], "struct<global_strength:double,total_observations:bigint>")
    m = smart(spark, d).select("row_no", s.alias("s")).where("s.global_strength is not null or s.total_observations is not null")
    return m.select("row_no", F.round(F.coalesce("s.global_strength", F.lit(0.5)), 6).alias("strength"), F.coalesce("s.total_observations", F.lit(0)).alias("observations"))


#: Names of contexts in other words.
CONTEXTS = {"早上": "morning", "上午": "morning", "下午": "afternoon", "傍晚": "evening", "晚上": "evening", "深夜": "night", "凌晨": "night", "工作日": "weekday", "平时": "weekday", "周末": "weekend", "假日": "weekend", "工作": "work", "上班": "work", "休闲": "leisure", "夏天": "summer", "冬天": "winter", "旅行": "travel", "出差": "travel"}


@query("x24_contexts", f"with s as ({SQL['a15_support_stats']}) select case lower(trim(coalesce(context, ''))) when '' then 'general' {' '.join(f'''when '{k}' then '{v}' ''' for k, v in CONTEXTS.items())} else lower(trim(context)) end as context, sum(confirmations)::bigint as confirmations, sum(contradictions)::bigint as contradictions from s group by 1")
def x24(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower(F.trim(F.coalesce("context", F.lit(""))))
    names = F.create_map(*[F.lit(x) for kv in CONTEXTS.items() for x in kv])
    return analytics.a15(spark, d).groupBy(F.when(low == "", "general").otherwise(F.coalesce(F.try_element_at(names, low), low)).alias("context")).agg(F.sum("confirmations").alias("confirmations"), F.sum("contradictions").alias("contradictions"))


@query("x13_identity", r"with t as (select row_no, regexp_extract(text, '(?i)introduced themselves as ((?:[^\W\d_]+[.,]? ){1,2}[^\W\d_]+)', 1) as who from memories where text is not null) select row_no, who from t where who <> ''")
def x13(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "memories").where("text is not null").select("row_no", F.regexp_extract("text", r"(?i)introduced themselves as ((?:[^\W\d_]+[.,]? ){1,2}[^\W\d_]+)", 1).alias("who"))
    return t.where("who != ''")


@query("x17_sections", r"with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null) select doc_id, count(*) filter (where regexp_matches(line, '^\s*#{1,6}\s')) as headings, count(*) filter (where regexp_matches(line, '^\s*[-*•]\s')) as bullets from l group by 1")
def x17(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    n = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))).cast("bigint")
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", n(r"^\s*#{1,6}\s").alias("headings"), n(r"^\s*[-*•]\s").alias("bullets"))


@query("t11_caps", f"with t as ({BOTH}), r as (select *, row_number() over (partition by doc_id order by length(content) desc, content, role) as n from t) select doc_id, role, length(content) as chars from r where n <= 5")
def t11(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.length("content")), "content", "role")
    return turns(spark, d).where("role != 'system'").withColumn("n", F.row_number().over(w)).where("n <= 5").select(F.col("conv_id").alias("doc_id"), "role", F.length("content").cast("bigint").alias("chars"))


_LINE = r"substr(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(m.l0, '[\r\n]+', ' ', 'g'), '</?[a-zA-Z][^>]*>', '', 'g'), '<', '＜'), '>', '＞'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 180)"
INJECTION = f"""{hits_sql()}, {FUSED}, {stages_sql()}, g as (select b.query_no, b.row_no, b.place, {_LINE} as line from best b join mem m using (row_no) where m.state = 'confirmed' and m.memory_layer not in ('archive', 'reflection')),
c as (select *, row_number() over w as n, sum(length(line)) over w - length(line) as before from g where line <> '' window w as (partition by query_no order by place)), inj as (select query_no, row_no, place, least(length(line), 600 - before)::bigint as taken from c where n <= 3 and before < 600)"""


def injected(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    return inject(hybrid(m, asked(spark, d), RecallConfig(NOW)).select("query_no", "row_no", F.col("place").cast("bigint").alias("place")), m)


@query("plan_p13_auto_recall", f"{INJECTION} select query_no, row_no, place, taken from inj")
def p13(spark: SparkSession, d: str) -> DataFrame:
    return injected(spark, d).select("query_no", "row_no", "place", "taken")


@query("m32_injection_notes", f"{INJECTION} select distinct row_no, 1::bigint as injected_count, bad_recall_count, 0::bigint as suppressed_until_turn from inj join mem using (row_no)")
def m32b(spark: SparkSession, d: str) -> DataFrame:
    return noted(injected(spark, d), smart(spark, d), NOW, 0).drop("last_injected_at")


@query("plan_p14_auto_capture", f"with t as ({BOTH}), c as (select doc_id, content, {X.CAPTURE_SQL.format(c='content')} as keep from t where role = 'user'), r as (select *, row_number() over (partition by doc_id order by length(content) desc, content) as n from c where keep) select doc_id, content, case {' '.join(f'''when regexp_matches(lower(content), {X._lit(p)}) then '{n}' ''' for n, p in X.CATEGORY_WORDS.items())} else 'other' end as category from r where n <= 2")
def p14(spark: SparkSession, d: str) -> DataFrame:
    c = turns(spark, d).where("role = 'user'").where(X.should_capture(F.col("content")))
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.length("content")), "content")
    return c.withColumn("n", F.row_number().over(w)).where("n <= 2").select(F.col("conv_id").alias("doc_id"), "content", X.storage_category(F.col("content")).alias("category"))


@query("plan_p19_resolve", f"with {Q}, h as (select query_no, row_no, 1 / (1 + (1 - raw)) as s from {knn_sql('memories', 'vector', 'vector', 5)}), g as (select query_no, count(*) as n, max(s) as top, arg_max(row_no, (s, -row_no)) as row_no from h group by 1) select query_no, row_no from g where n = 1 or top > 0.85")
def p19(spark: SparkSession, d: str) -> DataFrame:
    h = vector_hits(read_table(spark, d, "memories"), asked(spark, d), 5)
    g = h.groupBy("query_no").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.max_by("row_no", F.struct("score", -F.col("row_no"))).alias("row_no"))
    return g.where("n = 1 or top > 0.85").select("query_no", "row_no")


@query("plan_p20_explain", f"{hits_sql()}, {FUSED}, {stages_sql(20)} select query_no, row_no, round(fused, 6) as fused, round(length_norm - fused, 6) as by_length, round(decayed - length_norm, 6) as by_decay from best")
def p20(spark: SparkSession, d: str) -> DataFrame:
    best = hybrid(smart(spark, d), asked(spark, d), RecallConfig(NOW, limit=20))
    trace = F.struct(F.round("fused", 6).alias("fused"), F.round(F.col("length_norm") - F.col("fused"), 6).alias("by_length"), F.round(F.col("decayed") - F.col("length_norm"), 6).alias("by_decay"))
    return best.select("query_no", "row_no", trace.alias("t")).select("query_no", "row_no", "t.*")


TRIPLE = r"(?:^|[.!?] )([A-Z][a-z]+) (prefers|uses|owns|leads|reviewed|checks|sends) (?:that )?((?:[a-z]+ ){1,3}[a-z]+)"


@query("plan_p12_triples", rf"with t as (select row_no, regexp_extract(text, '{TRIPLE}', ['s', 'p', 'o']) as m from memories where text is not null) select row_no, m.s as subject, m.p as predicate, m.o as object from t where m.s <> ''")
def p12(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "memories").where("text is not null").select("row_no", *[F.regexp_extract("text", TRIPLE, i).alias(n) for i, n in ((1, "subject"), (2, "predicate"), (3, "object"))])
    return t.where("subject != ''")


@query("plan_p24_adapter_recall", f"""{hits_sql()}, {FUSED}, {stages_sql()}, c as (select query_no, row_no, place, sum(length(t)) over (partition by query_no order by place) as total from best) select query_no, row_no, place from c where total <= 600""")
def p24(spark: SparkSession, d: str) -> DataFrame:
    best = hybrid(smart(spark, d), asked(spark, d), RecallConfig(NOW)).select("query_no", "row_no", F.col("place").cast("bigint").alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    total = F.sum(F.length("text")).over(Window.partitionBy("query_no").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return best.withColumn("total", total).where("total <= 600").select("query_no", "row_no", "place")
