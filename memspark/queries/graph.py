"""Queries on the knowledge graph. Seeds are the three entities with most triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators import graph as G
from memspark.queries.base import query
from memspark.session import read_table

TITLE = lambda c: f"array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
EDGE = r"""[\s"''“”‘’「」『』【】\[\]()（）]+"""
CLEAN = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace({c}, '^{EDGE}', ''), '{EDGE}$', ''), '\s+', ' ', 'g'))"
NAME = lambda c: f"case when regexp_matches({CLEAN(c)}, '[一-鿿㐀-䶿]') then {CLEAN(c)} else {TITLE(CLEAN(c))} end"
WEIGHT = "(case predicate " + " ".join(f"when '{k}' then {v}" for k, v in G.PREDICATES.items()) + f" else {G.OTHER_PREDICATE} end)::double"
KG = rf"""with k0 as (select * from kg_triples qualify row_number() over (partition by id order by coalesce(timestamp_ms, 0) desc, coalesce(confidence, 0.0) desc) = 1),
k as (select id, case when scope is null or trim(scope) = '' then 'global' else lower(trim(scope)) end as scope, {NAME('subject')} as subject, regexp_replace(regexp_replace(lower(trim(predicate)), '[\s-]+', '_', 'g'), '[^a-z0-9_]', '', 'g') as predicate,
  {NAME('object')} as object, coalesce(confidence, 0.0) as confidence, source_memory_id from k0 where subject is not null and object is not null),
e as (select subject as src, object as dst, {WEIGHT} * confidence as w from k union all select object, subject, {WEIGHT} * confidence from k),
seeds as (select src as entity from e group by 1 order by count(*) desc, src limit 3)"""


def triples(spark: SparkSession, d: str) -> DataFrame:
    return G.upserted(read_table(spark, d, "kg_triples"))


def seeds(edge: DataFrame) -> DataFrame:
    return edge.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(3).select(F.col("src").alias("entity"))


@query("s11_kg_upsert", f"{KG} select * from k")
def s11(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d)


@query("s12_kg_delete_scope", f"{KG} select id from k where scope <> 'global'")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).where("scope != 'global'").select("id")


@query("x02_triple_id", "select distinct substr(sha256(concat_ws(chr(0), coalesce(scope, 'global'), subject, predicate, object)), 1, 32) as triple_id from kg_triples where subject is not null and predicate is not null and object is not null")
def x02(spark: SparkSession, d: str) -> DataFrame:
    k = read_table(spark, d, "kg_triples").where("subject is not null and predicate is not null and object is not null")
    return k.select(G.triple_id(F.coalesce("scope", F.lit("global")), F.col("subject"), F.col("predicate"), F.col("object")).alias("triple_id")).distinct()


@query("x04_entity_names", f"{KG} select subject, count(*) as n from k group by 1")
def x04(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("a18_kg_entities", f"{KG} select src as entity, count(*) as degree from e group by 1")
def a18(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(triples(spark, d)).groupBy(F.col("src").alias("entity")).agg(F.count(F.lit(1)).alias("degree"))


@query("a23_out_weights", f"{KG} select src as entity, round(sum(w), 6) as total from e group by 1")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(triples(spark, d)).groupBy(F.col("src").alias("entity")).agg(F.round(F.sum("w"), 6).alias("total"))


HOP = f"{KG}, h1 as (select distinct dst as entity from e join seeds on src = entity), h2 as (select distinct dst as entity from e join h1 on src = entity), hops as (select entity, min(h) as hops from (select entity, 0 as h from seeds union all select entity, 1 from h1 union all select entity, 2 from h2) group by 1)"


@query("j08_neighbourhood", f"{HOP} select entity, hops from hops")
def j08(spark: SparkSession, d: str) -> DataFrame:
    e = G.edges(triples(spark, d))
    return G.neighbourhood(e, seeds(e))


STEPS = 5
PPR = f"""{KG}, tot as (select src, sum(w) as t from e group by 1 having sum(w) > 0), fl as (select e.src, dst, sum(w) / any_value(t) as p from e join tot on e.src = tot.src group by 1, 2), home as (select entity, 1.0::double / 3 as seed from seeds), s0 as (select entity, seed as score from home)""" + "".join(
    f", s{i} as (select entity, sum(part) as score from (select dst as entity, 0.85 * score * p as part from s{i - 1} join fl on entity = src union all select entity, 0.15::double * seed from home) group by 1)" for i in range(1, STEPS + 1)
)


@query("j09_pagerank", f"{PPR} select entity, round(score, 6) as score from s{STEPS}")
def j09(spark: SparkSession, d: str) -> DataFrame:
    e = G.edges(triples(spark, d))
    return G.pagerank(e, seeds(e), STEPS, 0.0).select("entity", F.round("score", 6).alias("score"))


@query("t09_pagerank_top", f"{PPR}, h1 as (select distinct dst as entity from e join seeds on src = entity), h2 as (select distinct dst as entity from e join h1 on src = entity), near as (select entity from seeds union select entity from h1 union select entity from h2) select entity, round(score, 6) as score from s{STEPS} semi join near using (entity) where score > 0 order by round(score, 6) desc, entity limit 20")
def t09(spark: SparkSession, d: str) -> DataFrame:
    e = G.edges(triples(spark, d))
    start = seeds(e)
    s = G.pagerank(e, start, STEPS, 0.0).join(G.neighbourhood(e, start), "entity", "left_semi").where("score > 0")
    return s.select("entity", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "entity").limit(20)


@query("j10_graph_memories", f"""{PPR}, hit as (select source_memory_id, max(greatest(coalesce(a.score, 0), coalesce(b.score, 0)) * confidence) as score from k left join s{STEPS} a on a.entity = subject left join s{STEPS} b on b.entity = object where source_memory_id is not null group by 1)
select source_memory_id, round(score, 6) as score from hit where score > 0 order by round(score, 6) desc, source_memory_id limit 20""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d)
    e = G.edges(t)
    return G.memories_of(t, G.pagerank(e, seeds(e), STEPS, 0.0)).select("source_memory_id", F.round("score", 6).alias("score"))


# the three above stop after STEPS iterations, as their SQL does; these run to the operator's limit and tolerance
@query("j09_pagerank_full")
def j09_full(spark: SparkSession, d: str) -> DataFrame:
    e = G.edges(triples(spark, d))
    return G.pagerank(e, seeds(e)).select("entity", F.round("score", 6).alias("score"))


@query("t09_pagerank_top_full")
def t09_full(spark: SparkSession, d: str) -> DataFrame:
    e = G.edges(triples(spark, d))
    start = seeds(e)
    s = G.pagerank(e, start).join(G.neighbourhood(e, start), "entity", "left_semi").where("score > 0")
    return s.select("entity", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "entity").limit(20)


@query("j10_graph_memories_full")
def j10_full(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d)
    e = G.edges(t)
    return G.memories_of(t, G.pagerank(e, seeds(e))).select("source_memory_id", F.round("score", 6).alias("score"))


@query("plan_p05_graph_search")
def p05(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d)
    e = G.edges(t)
    best = G.memories_of(t, G.pagerank(e, seeds(e)))
    m = read_table(spark, d, "memories").groupBy("id").agg(F.min("row_no").alias("row_no"))
    return best.join(m, best["source_memory_id"] == m["id"]).select("row_no", "id", F.round("score", 6).alias("score"))


@query("m29_edge_weights", f"{KG} select id, round({WEIGHT} * confidence, 6) as w from k")
def m29(spark: SparkSession, d: str) -> DataFrame:
    return triples(spark, d).select("id", F.round(G.by_name(F.col("predicate"), G.PREDICATES, G.OTHER_PREDICATE) * F.col("confidence"), 6).alias("w"))


@query("j20_query_entities", f"""{KG}, q as (select row_no, unnest(regexp_extract_all(text, '\\b[A-Z][a-zA-Z]+\\b')) as cand from incoming_memories where row_no % 50 = 0), n as (select distinct src as entity from e)
select distinct row_no, entity from q join n on lower(cand) = lower(entity)""")
def j20(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "incoming_memories").where("row_no % 50 = 0").select("row_no", F.explode(F.regexp_extract_all("text", F.lit(r"((?<![A-Za-z0-9_])[A-Z][a-zA-Z]+(?![A-Za-z0-9_]))"), 1)).alias("cand"))
    n = G.edges(triples(spark, d)).select(F.col("src").alias("entity")).distinct()
    return q.join(n, F.lower("cand") == F.lower("entity")).select("row_no", "entity").distinct()
