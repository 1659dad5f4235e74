"""DuckDB SQL for the operators that SQL can express, by plain set arithmetic over whole tables."""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+')"


def _shingled(table: str, key: str, k: int, name: str) -> str:
    """CTEs ``<name>_w`` (key, w) and ``<name>`` (key, s): distinct shingles; fewer than k words make one."""
    return f"""{name}_w as (select {key}, {_WORDS} as w from {table}),
{name} as (select distinct {key}, s from (select {key}, unnest(case when len(w) >= {k} then list_transform(generate_series(1, len(w) - {k - 1}), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from {name}_w))"""


OP1 = f"""
with recursive {_shingled("documents", "doc_id", 4, "sh")},
n as (select doc_id, count(*) as n from sh group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as met from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * met >= 80 * (x.n + y.n - met)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on l.a = r.b),
comp as (select a as doc_id, min(b) as component_id from reach group by 1)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept from comp left join n using (doc_id)"""

_HALF = "substr(line, 1, m // 2)", "right(line, m // 2)"
OP2 = f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as no from documents where text is not null),
d as (select line, min((doc_id, no)) as first, length(line) as n from l where line <> '' group by line),
h as (select line, first, n, m, side, case side when 0 then {_HALF[0]} else {_HALF[1]} end as half from (select *, unnest([n, n - 1]) as m from d) cross join (values (0), (1)) s(side)),
cand as (select distinct a.line as x, a.n as nx, b.line as y, b.n as ny from h a join h b on a.m = b.m and a.side = b.side and a.half = b.half and a.first < b.first where abs(a.n - b.n) <= 1),
near as (select distinct y as line from cand where case when nx = ny then len(list_filter(range(1, nx + 1), lambda i: substr(x, 1, i - 1) = substr(y, 1, i - 1) and substr(x, i + 1) = substr(y, i + 1))) > 0
  when nx < ny then len(list_filter(range(1, ny + 1), lambda i: substr(y, 1, i - 1) || substr(y, i + 1) = x)) > 0 else len(list_filter(range(1, nx + 1), lambda i: substr(x, 1, i - 1) || substr(x, i + 1) = y)) > 0 end),
judged as (select l.doc_id, l.no, l.line, n.line is not null as near, coalesce(n.line is not null or (l.doc_id, l.no) <> d.first, false) as gone from l left join d on d.line = l.line left join near n on n.line = l.line)
select x.doc_id, cast(count(j.no) as bigint) as n_lines, cast(coalesce(sum(cast(gone as int)), 0) as bigint) as n_dropped, cast(coalesce(sum(cast(gone and near as int)), 0) as bigint) as n_near,
  coalesce(string_agg(cast(no as varchar), ',' order by no) filter (gone), '') as dropped, case when any_value(x.text) is not null then md5(coalesce(string_agg(line, chr(10) order by no) filter (not gone), '')) end as text_md5
from documents x left join judged j using (doc_id) group by 1"""

OP4 = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings where embedding is not null and list_sum(list_transform(cast(embedding as double[]), lambda x: x * x)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on l.a = r.b),
comp as (select a as vec_id, min(b) as component_id from reach group by 1), n as (select a as vec_id, count(*) as n from links group by 1)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept from comp left join n using (vec_id)"""

OP10 = f"""
with {_shingled("documents", "doc_id", 5, "sh")},
{_shingled("benchmark", "item_id", 5, "it")},
n as (select item_id, count(*) as n_item, any_value(len(w)) >= 5 as long from it join it_w using (item_id) group by 1),
met as (select doc_id, item_id, count(*) as n_shared from sh join it using (s) join n using (item_id) where long group by 1, 2
  union all select doc_id, item_id, 1 from sh_w d join it_w i on contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ') join n using (item_id) where not long)
select doc_id, item_id, cast(n_item as bigint) as n_item, cast(n_shared as bigint) as n_shared, n_shared / n_item as containment from met join n using (item_id) where 100 * n_shared >= 80 * n_item"""

_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
with d as (select doc_id, {_TERMS} as terms from documents),
s as (select count(*) as n_docs, cast(coalesce(sum(len(terms)), 0) as bigint) as n_terms from d where len(terms) > 0),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by 1, 2),
p as (select doc_id, n, term, count(*) as tf from (select doc_id, len(terms) as n, unnest(terms) as term from d) where term in (select term from q) group by 1, 2, 3),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p cross join s group by term, n_docs),
hits as (select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) as bigint) as score from q join p using (term) join w using (term) cross join s group by 1, 2)
select item_id, cast(rank as int) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from hits where score > 0) where rank <= 10"""
