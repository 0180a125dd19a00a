"""SQL of the general problems for the side-by-side check."""

P1_HISTORY = r"""
with recursive r as (
  select *, case when trim(coalesce(scope,''))='' then 'global' else lower(trim(scope)) end as sc,
    nullif(trim(regexp_replace(trim(regexp_replace(lower(fact_key), '\s+', ' ', 'g')), '[。.!?]+$', '')), '') as fk
  from fact_updates),
ids as (select memory_id, min(fk) as fk, min(sc) filter (where fk is not null) as ksc, min(supersedes) filter (where fk is null) as nxt from r where memory_id is not null group by 1),
walk as (
  select supersedes as start, supersedes as at_id, 0 as depth from r where fk is null and supersedes is not null
  union
  select w.start, i.nxt, w.depth + 1 from walk w join ids i on i.memory_id = w.at_id where i.fk is null and i.nxt is not null and w.depth < 200),
found as (select w.start, min(i.ksc) as sc, min(i.fk) as fk from walk w join ids i on i.memory_id = w.at_id where i.fk is not null group by 1),
facts as (
  select r.*, coalesce(case when r.fk is not null then r.sc end, f.sc) as fsc, coalesce(r.fk, f.fk) as ffk, coalesce(r.valid_from, r.timestamp_ms) as vf
  from r left join found f on r.fk is null and f.start = r.supersedes),
stand as (select * from facts where ffk is not null and vf is not null
  qualify row_number() over (partition by fsc, ffk, vf order by received_at desc, update_no desc) = 1),
ends as (select *, lead(vf) over (partition by fsc, ffk order by vf) as nv,
    case when invalidated_at >= vf then invalidated_at end as own from stand),
per as (select *, case when nv is null then own when own is null then nv else least(nv, own) end as e from ends),
per2 as (select * from per where e is null or e > vf),
flag as (select *, case when lag(e) over w = vf and lag(l2_content) over w is not distinct from l2_content and lag(tier) over w is not distinct from tier then 0 else 1 end as brk
  from per2 window w as (partition by fsc, ffk order by vf)),
grp as (select *, sum(brk) over (partition by fsc, ffk order by vf) as g from flag)
select fsc as scope, ffk as fact_key, min(vf) as valid_from, coalesce(max(e) filter (where nv is null or true), -1) as valid_to_max,
  case when count(*) filter (where e is null) > 0 then -1 else max(e) end as valid_to, min(l2_content) as l2_content, min(tier) as tier
from grp group by fsc, ffk, g
"""
P1_HISTORY = P1_HISTORY.replace("coalesce(max(e) filter (where nv is null or true), -1) as valid_to_max,\n  ", "")
P1_FOUND = f"select scope, fact_key, valid_from, valid_to from ({P1_HISTORY}) h"

P5_NODES = r"""
with m as (select row_no, metadata::json as j from memories where json_valid(metadata) and json_type(metadata::json) = 'OBJECT'),
parts as (
  select row_no, p, case when json_type(v) = 'VARCHAR' and json_valid(v->>'$') then (v->>'$')::json else v end as v from (
    select row_no, 'relations' as p, j->'$.relations' as v from m union all
    select row_no, 'provenance', j->'$.provenance' from m union all
    select row_no, 'support_info', j->'$.support_info' from m) where v is not null and json_type(v) <> 'NULL'),
els as (
  select row_no, p, (i - 1)::bigint as pos, case when json_type(v) = 'ARRAY' then json_extract(v, '$[' || (i - 1) || ']') else v end as e
  from (select row_no, p, v, unnest(range(1, 1 + case when json_type(v) = 'ARRAY' then json_array_length(v)::bigint else 1 end)) as i from parts)),
sub as (
  select row_no, p, pos, k, s from (
    select row_no, p, pos, 'evidence' as k, e->'$.evidence' as s from els where p = 'relations' union all
    select row_no, p, pos, 'derived_from', e->'$.derived_from' from els where p = 'provenance' union all
    select row_no, p, pos, 'slices', e->'$.slices' from els where p = 'support_info') where s is not null and json_type(s) <> 'NULL'),
subels as (
  select row_no, p, pos, k, (i - 1)::bigint as cpos, case when json_type(s) = 'ARRAY' then json_extract(s, '$[' || (i - 1) || ']') else s end as x
  from (select row_no, p, pos, k, s, unnest(range(1, 1 + case when json_type(s) = 'ARRAY' then json_array_length(s)::bigint else 1 end)) as i from sub))
select row_no, child_path, parent_pos, child_pos, link_value from (
  select row_no, 'relations' as child_path, -1::bigint as parent_pos, pos as child_pos,
    case when trim(coalesce(e->>'$.targetId','')) <> '' then e->>'$.targetId' when trim(coalesce(e->>'$.target_id','')) <> '' then e->>'$.target_id' else e->>'$.target' end as link_value
    from els where p = 'relations' and json_type(e) = 'OBJECT' union all
  select row_no, 'provenance', -1, pos, coalesce(e->>'$.session', '') from els where p = 'provenance' and json_type(e) = 'OBJECT' union all
  select row_no, 'relations.evidence', pos, cpos, coalesce(x->>'$.session', '') from subels where k = 'evidence' and json_type(x) = 'OBJECT' union all
  select row_no, 'provenance.derived_from', pos, cpos, x->>'$' from subels where k = 'derived_from' union all
  select row_no, 'support_info.slices', -1, cpos, coalesce(x->>'$.context', '') from subels where k = 'slices' and json_type(x) = 'OBJECT')
where link_value is not null and (child_path not in ('relations', 'provenance.derived_from') or trim(link_value) <> '')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p1_history": P1_HISTORY,
        "p5_found": P5_NODES,
        "p5_relations": f"select row_no, child_pos, link_value from ({P5_NODES}) n where child_path = 'relations'",
    }
