"""Registry of queries, and the SQL that all of them build on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memspark.metadata import store_rows, with_smart_meta
from memspark.session import read_table

#: The fixed present of all queries, epoch milliseconds: 2026-01-01 UTC.
NOW = 1_767_225_600_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under its name, with its SQL if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def smart(spark: SparkSession, d: str) -> DataFrame:
    """Store rows with their smart metadata."""
    return with_smart_meta(store_rows(read_table(spark, d, "memories")))


#: CTEs ``store`` (one row per id) and ``mem`` (normalised metadata).
MEM = r"""with store as (select * from memories where id is null or row_no in (select min(row_no) from memories group by id)),
j0 as (select *, case when json_valid(metadata) and json_type(metadata::json) = 'OBJECT' then metadata::json else '{}'::json end as j from store),
j1 as (select row_no, id, text, category, timestamp_ms, vector, vector_l0, vector_l1, vector_l2, metadata, j,
  case when scope is null or trim(scope) = '' then 'global' else lower(trim(scope)) end as scope, coalesce(importance, 0.7) as importance, coalesce(text, '') as t,
  case when json_type(j->'$.access_count') = 'NULL' then 0.0 else try_cast(j->>'$.access_count' as double) end as n_access,
  case when json_type(j->'$.confidence') = 'NULL' then 0.0 else try_cast(j->>'$.confidence' as double) end as n_conf,
  case when json_type(j->'$.last_accessed_at') = 'NULL' then 0.0 else try_cast(j->>'$.last_accessed_at' as double) end as n_last,
  case when json_type(j->'$.bad_recall_count') = 'NULL' then 0.0 else try_cast(j->>'$.bad_recall_count' as double) end as n_bad,
  try_cast(j->>'$.feedback_weight' as double) as n_fw, try_cast(j->>'$.valid_from' as double) as n_vf, try_cast(j->>'$.invalidated_at' as double) as n_inv from j0),
j2 as (select *, coalesce(nullif(regexp_replace(j->>'$.l0_abstract', '^\s+|\s+$', '', 'g'), ''), t) as l0, coalesce(nullif(regexp_replace(j->>'$.l2_content', '^\s+|\s+$', '', 'g'), ''), t) as l2,
  case when category = 'fact' and regexp_matches(t, '(?i)\b(my |i am |i''m |name is |叫我|我的|我是)\b') and length(text) < 200 then 'profile' when category = 'fact' then 'cases'
    when category = 'preference' then 'preferences' when category = 'entity' then 'entities' when category = 'decision' then 'events' else 'patterns' end as derived_category,
  case when coalesce(j->>'$.source', case when j->>'$.type' = 'session-summary' then 'session-summary' when j->>'$.type' in ('memory-reflection', 'memory-reflection-item') then 'reflection' else 'legacy' end)
      in ('manual', 'auto-capture', 'reflection', 'session-summary', 'consolidation', 'legacy')
    then coalesce(j->>'$.source', case when j->>'$.type' = 'session-summary' then 'session-summary' when j->>'$.type' in ('memory-reflection', 'memory-reflection-item') then 'reflection' else 'legacy' end) else 'legacy' end as source,
  case when j->>'$.tier' in ('core', 'working', 'peripheral') then j->>'$.tier' else 'working' end as tier,
  case when n_access >= 0 then floor(n_access)::bigint else 0 end as access_count, case when n_conf is null then 0.7 else greatest(0.0, least(1.0, n_conf)) end as confidence,
  case when n_fw is null then 0.5 else greatest(0.0, least(1.0, n_fw)) end as feedback_weight, case when n_last >= 0 then floor(n_last)::bigint else timestamp_ms end as last_accessed_at,
  case when n_bad >= 0 then floor(n_bad)::bigint else 0 end as bad_recall_count,
  coalesce(case when n_vf > 0 then floor(n_vf)::bigint end, timestamp_ms) as valid_from, case when n_inv > 0 then floor(n_inv)::bigint end as inv0,
  nullif(regexp_replace(j->>'$.supersedes', '^\s+|\s+$', '', 'g'), '') as supersedes, nullif(regexp_replace(j->>'$.superseded_by', '^\s+|\s+$', '', 'g'), '') as superseded_by,
  nullif(regexp_replace(j->>'$.canonical_id', '^\s+|\s+$', '', 'g'), '') as canonical_id, j->>'$.topic_tag' as topic_tag, j->>'$.state' as raw_state, (j->>'$.memory_category') is not null as has_category from j1),
j3 as (select *, coalesce(nullif(regexp_replace(j->>'$.l1_overview', '^\s+|\s+$', '', 'g'), ''), '- ' || l0) as l1, coalesce(j->>'$.memory_category', derived_category) as memory_category,
  case when coalesce(raw_state, case when source = 'session-summary' then 'archived' else 'confirmed' end) in ('pending', 'confirmed', 'archived')
    then coalesce(raw_state, case when source = 'session-summary' then 'archived' else 'confirmed' end) else 'confirmed' end as state,
  case when inv0 >= valid_from then inv0 end as invalidated_at,
  regexp_replace(coalesce(nullif(regexp_extract(regexp_replace(l0, '^\s+|\s+$', '', 'g'), '^(.{1,120}?)[：:]', 1), ''), nullif(regexp_extract(regexp_replace(l0, '^\s+|\s+$', '', 'g'), '^(.{1,120}?)(?:\s*->|\s*=>)', 1), ''), regexp_replace(l0, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') as topic0 from j2),
mem as (select *, case when coalesce(j->>'$.memory_layer', '') in ('durable', 'working', 'reflection', 'archive') then j->>'$.memory_layer' when j->>'$.memory_layer' is not null then 'working'
    when source in ('reflection', 'session-summary') then 'reflection' when state = 'archived' then 'archive' when derived_category in ('profile', 'preferences', 'events') then 'durable' else 'working' end as memory_layer,
  coalesce(nullif(regexp_replace(j->>'$.fact_key', '^\s+|\s+$', '', 'g'), ''), case when memory_category in ('preferences', 'entities') then memory_category || ':' ||
    nullif(regexp_replace(regexp_replace(lower(topic0), '[。.!?]+$', ''), '^\s+|\s+$', '', 'g'), '') end) as fact_key from j3)
"""
ACTIVE = f"(valid_from <= {NOW} and (invalidated_at is null or invalidated_at > {NOW}))"
