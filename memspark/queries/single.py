"""Single rules that other queries use together, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.metadata import active_at
from memspark.operators.search import bm25_hits, fuse, vector_hits
from memspark.plans.recall import LAYERS
from memspark.queries import analytics, extra, maintenance, more, retrieval
from memspark.queries.base import MEM, NOW, query, smart
from memspark.queries.retrieval import Q, asked, bm25_sql, fused_sql, hits_sql, knn_sql
from memspark.session import read_table

assert analytics and extra and maintenance and more and retrieval

@query("m01_cosine", f"with {Q} select query_no, row_no, round(raw, 6) as cosine from {knn_sql('memories', 'vector_l1', 'l1', 5)}")
def m01(spark: SparkSession, d: str) -> DataFrame:
    return vector_hits(read_table(spark, d, "memories"), asked(spark, d), 5, {"l1": "vector_l1"}).select("query_no", "row_no", F.round("raw", 6).alias("cosine"))


@query("m02_similarity", f"with {Q} select query_no, row_no, round(1 / (1 + (1 - raw)), 6) as score from {knn_sql('memories', 'vector_l2', 'l2', 5)}")
def m02(spark: SparkSession, d: str) -> DataFrame:
    return vector_hits(read_table(spark, d, "memories"), asked(spark, d), 5, {"l2": "vector_l2"}).select("query_no", "row_no", F.round("score", 6).alias("score"))


@query("m03_bm25_sigmoid", f"with {Q}, {bm25_sql('memories')} select query_no, row_no, round(1 / (1 + exp(-raw / 5)), 6) as score from bm where rank <= 5")
def m03(spark: SparkSession, d: str) -> DataFrame:
    return bm25_hits(read_table(spark, d, "memories"), asked(spark, d), 5).select("query_no", "row_no", F.round("score", 6).alias("score"))


@query("m05_bm25_rules", f"{hits_sql()}, {fused_sql({'vector': 0.35, 'l0': 0.15, 'l1': 0.10, 'l2': 0.10, 'bm25': 0.30})} select f.query_no, f.row_no, round(f.fused - f0.rrf, 6) as lift from fused f join f0 on f0.query_no = f.query_no and f0.row_no = f.row_no where f0.bm25 is not null")
def m05(spark: SparkSession, d: str) -> DataFrame:
    live = smart(spark, d).where(active_at(NOW))
    f = fuse(vector_hits(live, asked(spark, d), 20, LAYERS).unionByName(bm25_hits(live, asked(spark, d), 20)))
    return f.where("bm25 is not null").select("query_no", "row_no", F.round(F.col("fused") - F.col("rrf"), 6).alias("lift"))


#: Decay of reflections by kind: middle in days, steepness, weight, quality.
REFLECTION_KINDS = [("decision", 45.0, 0.25, 1.1, 1.0), ("user-model", 21.0, 0.3, 1.0, 0.95), ("agent-model", 10.0, 0.35, 0.95, 0.93), ("lesson", 7.0, 0.45, 0.9, 0.9)]
KINDS_SQL = "(values " + ", ".join(f"('{k}', {m}::double, {s}::double, {w}::double, {q}::double)" for k, m, s, w, q in REFLECTION_KINDS) + ") as k(kind, mid, steep, weight, quality)"


@query("m26_reflection_kinds", f"{MEM} select row_no, kind, round(weight * quality / (1 + exp(steep * (greatest(0.0, ({NOW} - timestamp_ms) / 86400000.0) - mid))), 6) as score from mem, {KINDS_SQL} where source = 'reflection'")
def m26(spark: SparkSession, d: str) -> DataFrame:
    age = F.greatest(F.lit(0.0), (F.lit(NOW) - F.col("timestamp_ms")) / F.lit(86_400_000.0))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.round(F.lit(w * q) / (1 + F.exp(F.lit(s) * (age - F.lit(m)))), 6).alias("score")) for k, m, s, w, q in REFLECTION_KINDS])
    return smart(spark, d).where("source = 'reflection'").select("row_no", F.inline(kinds))


@query("m31_clamps", "select row_no, greatest(0.0, least(1.0, coalesce(importance, 0.7) * 2 - 0.5))::double as clamped from memories")
def m31(spark: SparkSession, d: str) -> DataFrame:
    from memspark.functions.score import clamp01

    return read_table(spark, d, "memories").select("row_no", clamp01(F.coalesce("importance", F.lit(0.7)) * 2 - 0.5).alias("clamped"))


#: Cues of facts about the user that belong to the user's own profile.
PROFILE = r"(?i)(?:我的时区是|我的代词是|我是|我的身份是|my timezone is|my pronouns are|i am\b)|(?:时区|代词|协作方式|工作方式|语言偏好)"


@query("f19_workspace_boundary", f"{MEM} select row_no, memory_category = 'profile' or regexp_matches(t, {X._lit(PROFILE)}) as own_profile from mem")
def f19(spark: SparkSession, d: str) -> DataFrame:
    return smart(spark, d).select("row_no", ((F.col("memory_category") == "profile") | F.coalesce("text", F.lit("")).rlike(PROFILE)).alias("own_profile"))


#: How questions ask for what is related.
HOPS = {"friend_of": r"(\w+)'s\s+friends?|friends?\s+of\s+(\w+)", "uses": r"what\s+does\s+(\w+)\s+use|who\s+(?:uses?|works?\s+with)\s+(\w+)", "created_by": r"who\s+(?:created|built|wrote|made)\s+(\w+)", "depends_on": r"what\s+depends\s+on\s+(\w+)|(\w+)\s+depend(?:s|encies)", "manages": r"who\s+manages?\s+(\w+)", "member_of": r"(\w+)'s\s+team"}


@query("x09_hop_intent", f"select row_no, case {' '.join(f'''when regexp_matches(lower(text), {X._lit(p)}) then '{n}' ''' for n, p in HOPS.items())} else 'none' end as predicate from incoming_memories where text is not null")
def x09(spark: SparkSession, d: str) -> DataFrame:
    out = F.when(F.lit(False), F.lit(""))
    for n, p in HOPS.items():
        out = out.when(F.lower("text").rlike(p), F.lit(n))
    return read_table(spark, d, "incoming_memories").where("text is not null").select("row_no", out.otherwise("none").alias("predicate"))


@query("x06_contradictions", f"{MEM}, a as (select row_no, scope, fact_key, regexp_replace(t, '(?i)^(?:the user|user|they)\\s+', '') as b from mem where fact_key is not null), k as (select scope, fact_key, arg_min(b, row_no) as f, min(row_no) as first_row from a group by 1, 2) select row_no, first_row, regexp_matches(b, '^(?:doesn''t|does not|don''t|do not)\\s') <> regexp_matches(f, '^(?:doesn''t|does not|don''t|do not)\\s') as one_negates from a join k using (scope, fact_key) where row_no <> first_row")
def x06(spark: SparkSession, d: str) -> DataFrame:
    neg = lambda c: F.col(c).rlike(r"^(?:doesn't|does not|don't|do not)\s")
    a = smart(spark, d).where("fact_key is not null").select("row_no", "scope", "fact_key", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?i)^(?:the user|user|they)\s+", "").alias("b"))
    k = a.groupBy("scope", "fact_key").agg(F.min(F.struct("row_no", "b")).alias("s"), F.count(F.lit(1)).alias("n")).select("scope", "fact_key", F.col("s.row_no").alias("first_row"), F.col("s.b").alias("f"), "n")
    return X.join_groups(a, k, ["scope", "fact_key"], "n").where("row_no != first_row").select("row_no", "first_row", (neg("b") != neg("f")).alias("one_negates"))


@query("s15_reembed")
def s15(spark: SparkSession, d: str) -> DataFrame:
    from memspark.functions.embed import embed_column

    return read_table(spark, d, "memories").select("row_no", embed_column(F.coalesce("text", F.lit(""))).alias("vector"))


@query("s16_migrate", "select row_no, id, coalesce(text, '') as text, coalesce(category, 'other') as category, coalesce(scope, 'global') as scope from incoming_memories where id not in (select id from memories where id is not null) and id is not null")
def s16(spark: SparkSession, d: str) -> DataFrame:
    new = read_table(spark, d, "incoming_memories").where("id is not null").join(read_table(spark, d, "memories").select("id"), "id", "left_anti")
    return new.select("row_no", "id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("scope", F.lit("global")).alias("scope"))
