"""Recall and ingestion as whole pipelines. Every 50th incoming row asks, or is taken in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.text import NOISE_SQL
from memspark.operators import reflections as R
from memspark.operators.lexical import lexical_hits
from memspark.operators.rerank import rerank
from memspark.operators.search import bm25_hits, vector_hits
from memspark.plans.dispatch import retrieve, two_rounds
from memspark.plans.ingest import changes, decide, ingest_plan
from memspark.plans.recall import RecallConfig
from memspark.queries.base import ACTIVE, MEM, NOW, query, smart
from memspark.queries.retrieval import Q, USABLE, asked, bm25_sql, knn_sql
from memspark.session import read_table

CFG = RecallConfig(NOW)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "incoming_memories").where("row_no % 50 = 0")


@query("plan_p01_retrieve")
def p01(spark: SparkSession, d: str) -> DataFrame:
    """Half of the queries carry a tag, so that both ways are gone."""
    q = asked(spark, d).withColumn("text", F.when(F.col("query_no") % 100 == 0, F.col("text")).otherwise(F.concat(F.lit("env:prod "), F.coalesce("text", F.lit("")))))
    return retrieve(smart(spark, d), q, CFG).select("query_no", "row_no", "place", "kind", F.round("decayed", 6).alias("decayed"))


@query("j11_two_rounds")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return two_rounds(smart(spark, d), asked(spark, d), NOW).withColumn("score", F.round("score", 6))


_WORDS = lambda c: rf"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+'))"


@query("m09_rerank", f"""{MEM}, {Q}, {bm25_sql('mem')}, h as (select query_no, row_no, raw, 1 / (1 + (1 - raw)) as score from {knn_sql('mem', 'vector', 'vector', 20)}),
p as (select h.query_no, h.row_no, h.score, coalesce(1 / (1 + exp(-bm.raw / 5)), 0) as b, {_WORDS('qs.qtext')} as qw, {_WORDS('mem.text')} as tw from h join qs using (query_no) join mem on mem.row_no = h.row_no left join bm on bm.query_no = h.query_no and bm.row_no = h.row_no),
r as (select *, case when len(qw) = 0 then 0 else len(list_intersect(qw, tw)) / len(qw) end as given from p)
select query_no, row_no, round(case when given > 0 then greatest(score * case when b >= 0.75 then 0.95 when b >= 0.6 then 0.9 else 0.5 end, least(1.0, 0.6 * given + 0.4 * score)) else greatest(score * case when b >= 0.75 then 1.0 when b >= 0.6 then 0.95 else 0.8 end, 0.8 * score) end, 6) as score from r""")
def m09b(spark: SparkSession, d: str) -> DataFrame:
    m, q = smart(spark, d), asked(spark, d)
    words = bm25_hits(m, q, 20).select("query_no", "row_no", F.col("score").alias("bm25"))
    pool = vector_hits(m, q, 20).select("query_no", "row_no", "score").join(words, ["query_no", "row_no"], "left").join(m.select("row_no", "text", "vector"), "row_no")
    pool = pool.join(q.select("query_no", F.col("text").alias("query"), F.col("vector").alias("query_vector")), "query_no")
    return rerank(pool).select("query_no", "row_no", F.round("reranked", 6).alias("score"))


_KEY = r"""case when category = 'preference' then 'preferences' when category = 'entity' then 'entities' end || ':' || nullif(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(
  nullif(regexp_extract(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '^(.{1,120}?)[：:]', 1), ''), nullif(regexp_extract(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '^(.{1,120}?)(?:\s*->|\s*=>)', 1), ''), regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')), '[。.!?]+$', ''), '^\s+|\s+$', '', 'g'), '')"""


@query("plan_p07_ingest", f"""{MEM}, live as (select * from mem where {ACTIVE}),
n as (select row_no as query_no, coalesce(text, '') as ntext, vector::double[] as qv, case when trim(coalesce(scope, '')) = '' then 'global' else lower(trim(scope)) end as scope, {_KEY} as nkey from incoming_memories where row_no % 50 = 0),
f as (select *, min(query_no) over (partition by scope, ntext) as first_row, {NOISE_SQL.format(c='ntext')} as noise from n),
k as (select query_no, row_no, raw, row_number() over (partition by query_no order by raw desc, row_no) as rank from (select query_no, row_no, round(list_cosine_similarity(live.vector::double[], qv), 9) as raw from live join f on f.scope = live.scope and not noise where {USABLE('live.vector')} and {USABLE('qv')}) qualify rank <= 5),
h as (select k.*, 1 / (1 + (1 - raw)) as score, live.fact_key = f.nkey and lower(trim(live.t)) <> lower(trim(f.ntext)) as other from k join live using (row_no) join f using (query_no) where 1 / (1 + (1 - raw)) >= 0.1),
g as (select query_no, max(score) as top, arg_min(row_no, rank) filter (where other) as conflict, list_slice(list(row_no order by rank) filter (where score between 0.6 and 0.98), 1, 3) as near from h group by 1),
a as (select f.query_no as row_no, case when noise then 'noise_filtered' when top > 0.98 or first_row < f.query_no then 'duplicate' when conflict is not null then 'conflict_detected' else 'created' end as action, conflict, near from f left join g using (query_no))
select row_no, action, case when action = 'conflict_detected' then conflict end as conflict_row, case when action = 'created' then coalesce(near, []::bigint[]) else []::bigint[] end as link_rows from a""")
def p07(spark: SparkSession, d: str) -> DataFrame:
    return ingest_plan(smart(spark, d), candidates(spark, d), NOW)


@query("plan_p08_decisions")
def p08(spark: SparkSession, d: str) -> DataFrame:
    return decide(smart(spark, d), candidates(spark, d), NOW)


@query("plan_p09_changes")
def p09(spark: SparkSession, d: str) -> DataFrame:
    return changes(decide(smart(spark, d), candidates(spark, d), NOW), NOW)


# -- reflections: rows of that source, their kind told by their category -------------------------------------------------
_KIND = {"events": "decision", "profile": "user-model", "preferences": "user-model", "patterns": "agent-model"}


def reflections(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv])[F.col("memory_category")], F.lit("lesson"))
    meta = F.to_json(F.struct(F.lit("memory-reflection-mapped").alias("type"), kind.alias("mappedKind"), (F.col("row_no") % 3 == 0).alias("usedFallback")))
    return smart(spark, d).where("source = 'reflection'").withColumn("metadata", meta)


_TABLE = "(values " + ", ".join(f"('{k}', {m}::double, {s}::double, {w}::double, {q}::double)" for k, (m, s, w, q) in R.KINDS.items()) + ") as t(kind, mid, steep, weight, quality)"
_LINES = rf"""{MEM}, r as (select row_no, timestamp_ms, case memory_category {' '.join(f"when '{a}' then '{b}'" for a, b in _KIND.items())} else 'lesson' end as kind, regexp_replace(regexp_replace(replace(t, '**', ''), '(?i)^(invariants?|reflections?|derived)[:：]\s*', ''), '^ +| +$', '', 'g') as line from mem where source = 'reflection'),
l as (select row_no, kind, timestamp_ms, line, weight * quality * case when row_no % 3 = 0 then 0.75 else 1.0 end / (1 + exp(steep * (greatest(0.0, ({NOW} - timestamp_ms) / 86400000.0) - mid))) as score from r join {_TABLE} using (kind) where line <> '')"""


@query("m25_reflection_scores", f"{_LINES} select row_no, kind, round(score, 6) as score from l")
def m25(spark: SparkSession, d: str) -> DataFrame:
    return R.weighted_lines(reflections(spark, d), NOW).select("row_no", "kind", F.round("score", 6).alias("score"))


@query("a12_mapped_reflections", rf"""{_LINES}, g as (select kind, lower(regexp_replace(line, '\s+', ' ', 'g')) as k, round(sum(score), 9) as score, max(timestamp_ms) as latest, max(struct_pack(a := timestamp_ms, b := line)).b as line from l where score > 0 group by 1, 2)
select kind, line, round(score, 6) as score, latest from g qualify row_number() over (partition by kind order by score desc, latest desc, line) <= 10""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Without the usual bound of 60 days, as the present of the queries is later than that after all rows."""
    return R.ranked_lines(R.weighted_lines(reflections(spark, d), NOW), max_days=None).select("kind", "line", F.round("score", 6).alias("score"), "latest")


@query("t05_lexical_fallback", f"""{MEM}, {Q}, h as (select query_no, row_no, timestamp_ms, round(least(0.95, 0.72 + 0.02 * length(qq)) * greatest(case when contains(lower(t), qq) then 1.0 else 0 end, case when contains(lower(l0), qq) then 0.98 else 0 end, case when contains(lower(l1), qq) then 0.92 else 0 end, case when contains(lower(l2), qq) then 0.96 else 0 end), 9) as score
  from mem, (select query_no, lower(trim(coalesce(qtext, ''))) as qq from qs) q where qq <> '' and (contains(lower(t), qq) or contains(lower(l0), qq) or contains(lower(l1), qq) or contains(lower(l2), qq)))
select query_no, row_no, round(score, 6)::double as score, row_number() over (partition by query_no order by score desc, timestamp_ms desc nulls last, row_no) as rank from h qualify rank <= 10""")
def t05(spark: SparkSession, d: str) -> DataFrame:
    return lexical_hits(smart(spark, d), asked(spark, d), 10).select("query_no", "row_no", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))
