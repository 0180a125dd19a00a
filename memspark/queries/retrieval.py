"""Queries that search: every 50th incoming row asks all memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import score as S
from memspark.metadata import active_at, store_rows
from memspark.operators.search import bm25_hits, lexical_score, vector_hits
from memspark.operators.select import char_budget, demote_interference, mmr, relation_boost
from memspark.plans.ingest import lifts
from memspark.plans.recall import LAYERS, RecallConfig, bm25_only, diverse, hybrid, top, vector_only
from memspark.queries.base import ACTIVE, MEM, NOW, query, smart
from memspark.session import read_table

CFG = RecallConfig(NOW)


def asked(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "incoming_memories").where("row_no % 50 = 0").withColumnRenamed("row_no", "query_no")


Q = "qs as (select row_no as query_no, text as qtext, vector::double[] as qv, scope as qscope, category as qcategory, importance as qimportance from incoming_memories where row_no % 50 = 0)"
USABLE = lambda v: f"{v} is not null and list_dot_product({v}::double[], {v}::double[]) > 0"


def knn_sql(source: str, column: str, channel: str, k: int) -> str:
    return f"""(select query_no, '{channel}' as channel, row_no, raw, row_number() over (partition by query_no order by raw desc, row_no) as rank from (
  select query_no, row_no, round(list_cosine_similarity({column}::double[], qv), 9) as raw from {source}, qs where {USABLE(column)} and {USABLE('qv')}) qualify rank <= {k})"""


WORDS = lambda c: rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(source: str) -> str:
    """CTEs that end in ``bm(query_no, channel, row_no, raw, rank)``."""
    return f"""dw as (select row_no, {WORDS('text')} as w from {source}),
st as (select count(*) as n, avg(len(w)) as avgdl from dw), qw as (select distinct query_no, unnest({WORDS('qtext')}) as w from qs),
tf as (select row_no, len(dw.w) as dl, u.w as w, count(*) as tf from dw, unnest(dw.w) as u(w) group by all), df as (select w, count(*) as df from tf group by 1),
bs as (select query_no, row_no, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as raw from qw join tf using (w) join df using (w), st group by 1, 2),
bm as (select query_no, 'bm25' as channel, row_no, raw, row_number() over (partition by query_no order by raw desc, row_no) as rank from bs qualify rank <= 20)"""


SCORED = "case when channel = 'bm25' then 1 / (1 + exp(-raw / 5)) else 1 / (1 + (1 - raw)) end as score"


def hits_sql(k: int = 20, with_bm25: bool = True) -> str:
    """CTEs that end in ``hits(query_no, channel, row_no, raw, rank, score)`` over active rows."""
    vec = " union all ".join(f"select * from {knn_sql('live', c, n, k)}" for n, c in LAYERS.items())
    return f"{MEM}, {Q}, live as (select * from mem where {ACTIVE}), {bm25_sql('live')}, hits as (select *, {SCORED} from ({vec}{' union all select * from bm' if with_bm25 else ''}))"


def fused_sql(weights: dict[str, float]) -> str:
    w = "case channel " + " ".join(f"when '{c}' then {v}" for c, v in weights.items()) + " else 0 end"
    return f"""f0 as (select query_no, row_no, sum({w} / (60.0 + rank)) as rrf, max(case when channel = 'bm25' then score end) as bm25, max(case when channel = 'vector' then score end) as vec from hits group by 1, 2),
fused as (select query_no, row_no, case when vec is null and bm25 is not null then least(1.0, bm25) when bm25 >= 0.75 then greatest(rrf, bm25 * 0.92) else rrf end as fused from f0)"""


def stages_sql(limit: int = 10) -> str:
    from memspark.functions.text import NOISE_SQL

    return f"""g0 as (select query_no, m.row_no, fused, fused / (1 + 0.5 * log2(greatest(length(t) / 500.0, 1.0))) as length_norm, tier, importance, confidence, access_count, last_accessed_at, timestamp_ms, t from fused join mem m using (row_no)),
g1 as (select *, exp(-ln(2) / (30 * exp(1.5 * importance)) * pow(greatest(0.0, ({NOW} - case when access_count > 0 then last_accessed_at else timestamp_ms end) / 86400000.0), case tier when 'core' then 0.8 when 'peripheral' then 1.3 else 1.0 end)) as r,
  (1 - exp(-access_count / 5.0)) * case when access_count <= 1 then 1.0 else 0.5 + 0.5 * exp(-(greatest(1.0, (last_accessed_at - timestamp_ms) / 86400000.0) / greatest(access_count - 1, 1)) / 30) end as f, importance * confidence as i from g0 where not {NOISE_SQL.format(c='t')}),
g2 as (select *, greatest(0.4 * r + 0.3 * f + 0.3 * i, case tier when 'core' then 0.9 when 'peripheral' then 0.5 else 0.7 end) as composite from g1),
g3 as (select *, length_norm * least(1.0, greatest(0.3, 0.3 + 0.7 * composite)) as decayed from g2),
best as (select *, row_number() over (partition by query_no order by round(decayed, 9) desc, row_no) as place from g3 qualify place <= {limit})"""


OUT = "select query_no, row_no, place, round(fused, 6) as fused, round(length_norm, 6) as length_norm, round(decayed, 6) as decayed from best"


def shown(df: DataFrame) -> DataFrame:
    return df.select("query_no", "row_no", F.col("place").cast("bigint").alias("place"), *[F.round(c, 6).alias(c) for c in ("fused", "length_norm", "decayed")])


@query("j01_knn", f"with {Q}, store as (select * from memories where row_no in (select min(row_no) from memories group by id)), h as (select *, 1 / (1 + (1 - raw)) as score from {knn_sql('store', 'vector', 'vector', 5)}) select query_no, row_no, rank, round(score, 6) as score from h where score >= 0.3")
def j01(spark: SparkSession, d: str) -> DataFrame:
    return vector_hits(store_rows(read_table(spark, d, "memories")), asked(spark, d), 5).where("score >= 0.3").select("query_no", "row_no", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("j01_knn_embeddings", f"""with qs as (select vec_id as query_no, embedding::double[] as qv from embeddings where vec_id % 50 = 0), h as (select query_no, vec_id, round(list_cosine_similarity(embedding::double[], qv), 9) as raw from embeddings, qs where vec_id <> query_no)
select query_no, vec_id as row_no, round(raw, 6) as cosine from h qualify row_number() over (partition by query_no order by raw desc, vec_id) <= 5""")
def j01b(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row_no"), F.col("embedding").alias("vector"))
    hits = vector_hits(e, e.where("row_no % 50 = 0").withColumnRenamed("row_no", "query_no"), 6).where("row_no != query_no")
    w = Window.partitionBy("query_no").orderBy("rank")
    return hits.withColumn("n", F.row_number().over(w)).where("n <= 5").select("query_no", "row_no", F.round("raw", 6).alias("cosine"))


@query("w01_channel_ranks", f"{hits_sql(20, False)} select query_no, channel, row_no, rank, round(score, 6) as score from hits")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return vector_hits(smart(spark, d).where(active_at(NOW)), asked(spark, d), 20, LAYERS).select("query_no", "channel", "row_no", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("s30_postings", f"with d as (select row_no, {WORDS('text')} as w from memories) select u.w as term, count(*) as occurrences, count(distinct row_no) as df from d, unnest(d.w) as u(w) group by 1")
def s30(spark: SparkSession, d: str) -> DataFrame:
    from memspark.sources.text_index import postings

    return postings(read_table(spark, d, "memories")).groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("df"))


@query("plan_p06_bm25", f"{MEM}, {Q}, {bm25_sql('mem')} select query_no, row_no, rank, round(raw, 6) as raw, round(1 / (1 + exp(-raw / 5)), 6) as score from bm")
def p06(spark: SparkSession, d: str) -> DataFrame:
    return bm25_hits(smart(spark, d), asked(spark, d), 20).select("query_no", "row_no", F.col("rank").cast("bigint").alias("rank"), F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


@query("m04_lexical", f"""{MEM}, q as (select distinct topic_tag as q from mem where topic_tag is not null)
select row_no, q.q as query, round(greatest(case when contains(lower(t), q.q) then 1.0 end, case when contains(lower(l0), q.q) then 0.98 end, case when contains(lower(l1), q.q) then 0.92 end, case when contains(lower(l2), q.q) then 0.96 end) * least(0.95, 0.72 + 0.02 * length(q.q))::double, 6)::double as score
from mem, q where contains(lower(t), q.q) or contains(lower(l0), q.q) or contains(lower(l1), q.q) or contains(lower(l2), q.q)""")
def m04(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    tags = [r[0] for r in m.where("topic_tag is not null").select("topic_tag").distinct().orderBy("topic_tag").collect()]  # as many as there are topics
    layers = {"text": F.coalesce("text", F.lit("")), "l0": F.col("l0"), "l1": F.col("l1"), "l2": F.col("l2")}
    found = F.filter(F.array(*[F.struct(F.lit(t).alias("query"), F.round(lexical_score(F.lit(t), layers), 6).alias("score")) for t in tags]), lambda x: x["score"].isNotNull())
    return m.select("row_no", F.inline(found))


@query("a02_rrf", f"{hits_sql()}, {fused_sql({'vector': 0.35, 'l0': 0.15, 'l1': 0.10, 'l2': 0.10, 'bm25': 0.30})} select query_no, row_no, round(fused, 6) as fused from fused")
def a02(spark: SparkSession, d: str) -> DataFrame:
    from memspark.operators.search import fuse

    live = smart(spark, d).where(active_at(NOW))
    return fuse(vector_hits(live, asked(spark, d), 20, LAYERS).unionByName(bm25_hits(live, asked(spark, d), 20))).select("query_no", "row_no", F.round("fused", 6).alias("fused"))


@query("plan_p02_hybrid", f"{hits_sql()}, {fused_sql({'vector': 0.35, 'l0': 0.15, 'l1': 0.10, 'l2': 0.10, 'bm25': 0.30})}, {stages_sql()} {OUT}")
def p02(spark: SparkSession, d: str) -> DataFrame:
    return shown(hybrid(smart(spark, d), asked(spark, d), CFG))


@query("plan_p03_vector_only", f"{hits_sql(20, False)}, {fused_sql({'vector': 0.5, 'l0': 0.2, 'l1': 0.15, 'l2': 0.15})}, {stages_sql()} {OUT}")
def p03(spark: SparkSession, d: str) -> DataFrame:
    return shown(vector_only(smart(spark, d), asked(spark, d), CFG))


@query("plan_p04_bm25_only", f"{MEM}, {Q}, live as (select * from mem where {ACTIVE}), {bm25_sql('live')}, hits as (select *, {SCORED} from bm), {fused_sql({'bm25': 0.3})}, {stages_sql()} {OUT}")
def p04(spark: SparkSession, d: str) -> DataFrame:
    return shown(bm25_only(smart(spark, d), asked(spark, d), CFG))


@query("t07_mmr")
def t07(spark: SparkSession, d: str) -> DataFrame:
    return diverse(smart(spark, d), asked(spark, d), CFG)


@query("t08_rif")
def t08(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    hits = vector_hits(m, asked(spark, d), 20).select("query_no", "row_no", "score")
    return demote_interference(hits.join(m.select("row_no", "vector"), "row_no"))


@query("t07_mmr_labels")
def t07b(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row_no"), F.col("embedding").alias("vector"))
    hits = vector_hits(e, e.where("row_no % 50 = 0").withColumnRenamed("row_no", "query_no"), 20).select("query_no", "row_no", "score")
    return mmr(hits.join(e, "row_no"), 5)


POOL = f"pool as (select h.query_no, h.row_no, m.id, 1 / (1 + (1 - raw)) as score, case when json_type(j->'$.relations') = 'ARRAY' then list_filter(list_transform((j->'$.relations')::json[], lambda e: e->>'$.targetId'), lambda x: x is not null) else [] end as targets from {knn_sql('mem', 'vector', 'vector', 20)} h join mem m using (row_no))"


@query("j04_relation_boost", f"""{MEM}, {Q}, {POOL}, l as (select query_no, id, unnest(targets) as target from pool), f as (select l.query_no, l.id, count(*) as f from l join (select distinct query_no, id from pool) p on p.query_no = l.query_no and p.id = l.target group by 1, 2),
r as (select query_no, target as id, count(distinct id) as r from l group by 1, 2)
select query_no, row_no, round(case when coalesce(f, 0) + coalesce(r, 0) > 0 then least(1.0, score + least((coalesce(f, 0) + coalesce(r, 0)) * 0.03, 0.09)) else score end, 6) as boosted from pool left join f using (query_no, id) left join r using (query_no, id)""")
def j04(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    raw = F.from_json("metadata", "map<string,string>")["relations"]
    listed = F.col("metadata").rlike(r'"relations"\s*:\s*\[')
    targets = F.when(listed, F.filter(F.from_json(raw, "array<struct<targetId:string>>")["targetId"], lambda x: x.isNotNull()))
    pool = vector_hits(m, asked(spark, d), 20).select("query_no", "row_no", "score").join(m.select("row_no", "id", F.coalesce(targets, F.array().cast("array<string>")).alias("targets")), "row_no")
    return relation_boost(pool).select("query_no", "row_no", F.round("boosted", 6).alias("boosted"))


@query("w02_char_budget", f"""{hits_sql()}, {fused_sql({'vector': 0.35, 'l0': 0.15, 'l1': 0.10, 'l2': 0.10, 'bm25': 0.30})}, {stages_sql()},
b as (select query_no, row_no, place, sum(length(t)) over (partition by query_no order by place) as total from best), c as (select *, max(case when total > 1200 and place > 1 then 1 else 0 end) over (partition by query_no order by place) as over_ from b)
select query_no, row_no, place, total::bigint as total from c where over_ = 0""")
def w02(spark: SparkSession, d: str) -> DataFrame:
    best = hybrid(smart(spark, d), asked(spark, d), CFG)
    return char_budget(best.select("query_no", "row_no", F.col("place").cast("bigint").alias("place"), F.coalesce("text", F.lit("")).alias("text")), 10, 1200).select("query_no", "row_no", "place", "total")


EXPECTED = "select i.row_no as query_no, list(distinct m.row_no) as expected from incoming_memories i join store m on lower(i.text) = lower(m.text) where i.row_no % 50 = 0 group by 1"


@query("a08_ir_metrics", f"""with {Q}, store as (select * from memories where row_no in (select min(row_no) from memories group by id)), h as (select * from {knn_sql('store', 'vector', 'vector', 5)}), x as (select row_no as query_no, category as want from incoming_memories where row_no % 50 = 0),
j as (select h.query_no, h.rank, (s.category = x.want)::int as hit from h join store s using (row_no) join x using (query_no))
select query_no, round(sum(hit) / count(*), 6) as precision_at_5, round(coalesce(1.0 / min(case when hit = 1 then rank end), 0), 6) as mrr, (count(*) - sum(hit))::bigint as contamination from j group by 1""")
def a08(spark: SparkSession, d: str) -> DataFrame:
    from memspark.operators.evaluate import judged

    return judged(_category_results(spark, d))


def _category_results(spark: SparkSession, d: str) -> DataFrame:
    s = store_rows(read_table(spark, d, "memories"))
    hits = vector_hits(s, asked(spark, d), 5).join(s.select("row_no", "category"), "row_no")
    return hits.join(asked(spark, d).select("query_no", F.col("category").alias("want")), "query_no").select("query_no", "rank", (F.col("category") == F.col("want")).alias("hit"))


@query("a09_suite", f"""with {Q}, store as (select * from memories where row_no in (select min(row_no) from memories group by id)), h as (select * from {knn_sql('store', 'vector', 'vector', 5)}), x as (select row_no as query_no, category as want from incoming_memories where row_no % 50 = 0),
j as (select h.query_no, h.rank, (s.category = x.want)::int as hit from h join store s using (row_no) join x using (query_no)),
q as (select query_no, sum(hit) / count(*) as p, coalesce(1.0 / min(case when hit = 1 then rank end), 0) as mrr, count(*) - sum(hit) as con from j group by 1)
select count(*) as queries, round(avg(p), 6) as precision_at_5, round(avg(mrr), 6) as mrr, round(avg(con), 6) as contamination, list_sort(list(con))[greatest(1, ceil(0.5 * count(*)))::int]::bigint as contamination_p50, list_sort(list(con))[greatest(1, ceil(0.99 * count(*)))::int]::bigint as contamination_p99 from q""")
def a09(spark: SparkSession, d: str) -> DataFrame:
    from memspark.operators.evaluate import judged, suite

    return suite(judged(_category_results(spark, d)))


@query("a21_novelty", f"with {Q}, h as (select * from {knn_sql('memories', 'vector', 'vector', 8)}) select query_no, round(1 - greatest(0.0, max(raw)), 6) as novelty, count(*) filter (where raw >= 0.55) as matched from h group by 1")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return vector_hits(read_table(spark, d, "memories"), asked(spark, d), 8).groupBy("query_no").agg(F.round(1 - F.greatest(F.lit(0.0), F.max("raw")), 6).alias("novelty"), F.count_if(F.col("raw") >= 0.55).alias("matched"))


@query("j12_precheck", f"with {Q}, h as (select *, 1 / (1 + (1 - raw)) as score from {knn_sql('memories', 'vector', 'vector', 1)}) select query_no, row_no, round(score, 6) as score from h where score > 0.95")
def j12(spark: SparkSession, d: str) -> DataFrame:
    return vector_hits(read_table(spark, d, "memories"), asked(spark, d), 1).where("score > 0.95").select("query_no", "row_no", F.round("score", 6).alias("score"))


@query("j13_auto_link", f"""{MEM}, {Q}, h as (select query_no, row_no, 1 / (1 + (1 - raw)) as score from {knn_sql('mem', 'vector', 'vector', 20)}), k as (select * from h where score between 0.6 and 0.98 qualify row_number() over (partition by query_no order by score desc, row_no) <= 3)
select query_no as from_row, row_no as to_row, 'related_to' as type from k union all select row_no, query_no, 'related_to' from k""")
def j13(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("query_no").orderBy("rank")
    k = vector_hits(smart(spark, d), asked(spark, d), 20).where("score between 0.6 and 0.98").withColumn("n", F.row_number().over(w)).where("n <= 3")
    both = F.array(F.struct(F.col("query_no").alias("from_row"), F.col("row_no").alias("to_row")), F.struct(F.col("row_no").alias("from_row"), F.col("query_no").alias("to_row")))
    return k.select(F.inline(both)).withColumn("type", F.lit("related_to"))


@query("j14_admission_neighbours", f"""{MEM}, {Q}, h as (select query_no, h.row_no, h.rank, (m.category = q.qcategory)::int as same from {knn_sql('mem', 'vector', 'vector', 8)} h join mem m using (row_no) join qs q using (query_no)), s as (select *, max(same) over (partition by query_no) as any_same from h)
select query_no, row_no from s where same = any_same or any_same = 0""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    h = vector_hits(m, asked(spark, d), 8).join(m.select("row_no", "category"), "row_no").join(asked(spark, d).select("query_no", F.col("category").alias("want")), "query_no").withColumn("same", (F.col("category") == F.col("want")).cast("int"))
    return h.withColumn("any_same", F.max("same").over(Window.partitionBy("query_no"))).where("same = any_same or any_same = 0").select("query_no", "row_no")


@query("j15_retroactive_boost", f"""{MEM}, {Q}, h as (select query_no, row_no, 1 / (1 + (1 - raw)) as score from {knn_sql('mem', 'vector', 'vector', 20)})
select query_no, h.row_no, round(least(0.75, m.importance + 0.15), 6) as new_importance, case when m.tier = 'peripheral' and least(0.75, m.importance + 0.15) >= 0.5 then 'working' else m.tier end as new_tier
from h join mem m using (row_no) join qs using (query_no) where qimportance >= 0.8 and score >= 0.72 and m.importance < 0.6 and {NOW} - m.timestamp_ms >= 86400000 qualify row_number() over (partition by query_no order by score desc, row_no) <= 5""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    return lifts(smart(spark, d), asked(spark, d), NOW).withColumn("new_importance", F.round("new_importance", 6))


@query("j16_cascade_forget", f"""{MEM}, {Q}, h as (select query_no, row_no, 1 / (1 + (1 - raw)) as score from {knn_sql('mem', 'vector', 'vector', 10)}), c as (select query_no, row_no, m.importance, greatest(0.05, m.importance - 0.3 * (score - 0.7) / 0.3) as new_importance from h join mem m using (row_no) where score >= 0.7)
select query_no, row_no, round(new_importance, 6) as new_importance from c where importance - new_importance >= 0.01""")
def j16(spark: SparkSession, d: str) -> DataFrame:
    m = smart(spark, d)
    h = vector_hits(m, asked(spark, d), 10).where("score >= 0.7").join(m.select("row_no", "importance"), "row_no")
    h = h.withColumn("new_importance", F.greatest(F.lit(0.05), F.col("importance") - 0.3 * (F.col("score") - 0.7) / 0.3))
    return h.where("importance - new_importance >= 0.01").select("query_no", "row_no", F.round("new_importance", 6).alias("new_importance"))


@query("m08_query_class", r"""select row_no, case when regexp_matches(lower(trim(text)), '\b(when|date|time|ago|yesterday|last week|last month|before|after|during)\b') then 'temporal'
 when regexp_matches(lower(trim(text)), '^(what|who|where|why|how|which|did|does|is|are|was|were|can|could)\b') or ends_with(lower(trim(text)), '?') then 'question' when len(regexp_split_to_array(lower(trim(text)), '\s+')) <= 3 then 'lookup' else 'general' end as kind from incoming_memories where text is not null""")
def m08(spark: SparkSession, d: str) -> DataFrame:
    q = F.lower(F.trim("text"))
    kind = (
        F.when(q.rlike(r"\b(when|date|time|ago|yesterday|last week|last month|before|after|during)\b"), "temporal")
        .when(q.rlike(r"^(what|who|where|why|how|which|did|does|is|are|was|were|can|could)\b") | q.endswith("?"), "question")
        .when(F.size(F.split(q, r"\s+")) <= 3, "lookup")
        .otherwise("general")
    )
    return read_table(spark, d, "incoming_memories").where("text is not null").select("row_no", kind.alias("kind"))


__all__ = ["S", "top"]
