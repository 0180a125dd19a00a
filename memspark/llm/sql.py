"""SQL of the problems on text corpora that SQL can express."""

L2 = r"(select row_no, metadata::json as j from memories where json_valid(metadata) and json_type(metadata::json) = 'OBJECT')"

P3 = rf"""
with f as (select row_no, 'text' as field_name, text as c from memories union all
  select row_no, 'l2_content', j->>'$.l2_content' from {L2} where json_type(j->'$.l2_content') = 'VARCHAR')
select row_no, field_name, case when list_max(list_transform(regexp_split_to_array(c, '[\s.!?。！？]'), lambda x: length(x))) > 4000 then 'forced' else 'natural' end as kind
from f where length(c) > 4000
"""

_W = lambda c: rf"array_to_string(regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+'), ' ')"
_NAME, _VALUE = r"regexp_extract(p, '^\s*([^:=]{1,80}?)\s*(?::|=>|->|=)(?s:(.*))$', 1)", r"regexp_extract(p, '^\s*([^:=]{1,80}?)\s*(?::|=>|->|=)(?s:(.*))$', 2)"

P6 = rf"""
with m as (select row_no, case when trim(coalesce(scope, '')) = '' then 'global' else lower(trim(scope)) end as scope, coalesce(text, '') as t from memories),
q as (select *, {_W('t')} as seq, case when json_valid(t) and starts_with(trim(t, e' \n\r\t'), '{{') then json_keys(t::json) end as keys from m),
js as (select row_no, list_sort(list_transform(keys, lambda k: {_W('k')} || chr(31) || {_W("json_extract_string(t, '$.' || chr(34) || k || chr(34))")})) as f from q where len(keys) > 1),
s as (select row_no, sep, list_filter(regexp_split_to_array(t, sep), lambda p: trim(p, e' \n\r\t') <> '') as parts from q, (values ('[\r\n]+', 1), ('\|', 2), (';', 3), (',', 4)) as v(sep, ord) where row_no not in (select row_no from js)),
ok as (select row_no, case sep when '[\r\n]+' then 1 when '\|' then 2 when ';' then 3 else 4 end as ord, list_sort(list_transform(parts, lambda p: {_W(_NAME)} || chr(31) || {_W(_VALUE)})) as f from s
  where len(parts) > 1 and len(list_filter(parts, lambda p: len(regexp_extract_all({_NAME}, '[\p{{L}}\p{{N}}]+')) between 1 and 4)) = len(parts)),
fld as (select row_no, f from js union all select row_no, arg_min(f, ord) from ok group by 1),
a as (select q.row_no, q.scope, q.seq, fld.f from q left join fld using (row_no)),
g as (select scope, seq, min(row_no) as first_row, min(f) as f from a group by 1, 2),
h as (select scope, f, min(first_row) as all_first from g where f is not null group by 1, 2),
c as (select g.scope, g.seq, least(first_row, coalesce(all_first, first_row)) as first_row_no from g left join h on g.scope = h.scope and g.f = h.f)
select first_row_no, row_no from a join c using (scope, seq) where row_no <> first_row_no
"""


P3_REJOINED = f"""
with f as (select row_no, 'text' as field_name, text as c from memories union all
  select row_no, 'l2_content', j->>'$.l2_content' from {L2} where json_type(j->'$.l2_content') = 'VARCHAR')
select row_no, field_name, true as fits, true as overlaps, md5(c) as digest from f where length(c) > 4000
"""

P6_RECORDS = f"""
with pairs as ({P6}), n as (select first_row_no, count(*) + 1 as copies from pairs group by 1)
select m.row_no, m.id, m.text, m.scope, coalesce(n.copies, 1)::bigint as copies from memories m left join n on n.first_row_no = m.row_no where m.row_no not in (select row_no from pairs)
"""

P9_BOUNDS = "select mix_name, true as whole, true as within from mix_targets where target_weight > 0 group by 1"


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3, "p3_rejoined": P3_REJOINED, "p6_found": P6, "p6_records": P6_RECORDS, "p9_bounds": P9_BOUNDS}
