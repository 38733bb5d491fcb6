"""DuckDB SQL for the training-data queries whose whole result SQL states: exact rules in place of grids, sketches and bands."""

from __future__ import annotations

COMPONENTS = """
reach as (
  select a, b from links
  union
  select r.a, l.b from reach r join links l on l.a = r.b
), least as (select a, least(a, min(b)) as component_id from reach group by a)
"""

OP2_SQL = f"""
with recursive sound as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select x.vec_id as a, y.vec_id as b from sound x join sound y on x.label = y.label and len(x.v) = len(y.v) and x.vec_id <> y.vec_id
  where list_cosine_similarity(x.v, y.v) >= 0.98
), {COMPONENTS}, degree as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(d.n_links, 0) as n_links, coalesce(l.component_id, e.vec_id) as component_id, coalesce(l.component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join degree d on d.a = e.vec_id left join least l on l.a = e.vec_id
"""

OP3_SQL = r"""
with cut as (
  select doc_id, coalesce('s' || source, 'd' || doc_id) as site, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos
  from documents where text is not null
), keyed as (
  select *, case when regexp_matches(line, '[\p{L}\p{N}]') then lower(trim(line, ' ')) end as k from cut
), wide as (
  select k, min({'doc_id': doc_id, 'pos': pos}) as earliest from keyed where k is not null group by k having count(distinct site) >= 2
), marked as (
  select x.doc_id, x.pos, x.line, w.k is not null and {'doc_id': x.doc_id, 'pos': x.pos} <> w.earliest as gone from keyed x left join wide w on w.k = x.k
), cleaned as (
  select doc_id, count(*) filter (gone) as removed, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as rest from marked group by doc_id
)
select d.doc_id, case when removed > 0 then rest else text end as text, case when removed > 0 then length(rest) else n_chars end as n_chars,
  coalesce(removed, 0) as lines_removed
from documents d left join cleaned c on c.doc_id = d.doc_id
"""

OP7_SQL = rf"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from worded
), sized as (select doc_id, len(s) as n_shingles from sets
), shingles as (select doc_id, unnest(s) as shingle from sets
), shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as n from shingles x join shingles y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id
), links as (
  select a, b from shared join sized p on p.doc_id = a join sized q on q.doc_id = b where 100 * n >= 75 * (p.n_shingles + q.n_shingles - n)
), {COMPONENTS}
select z.doc_id, z.n_shingles, coalesce(l.component_id, z.doc_id) as component_id, coalesce(l.component_id, z.doc_id) = z.doc_id as kept
from sized z left join least l on l.a = z.doc_id
"""

OP12_SQL = r"""
with docs as (
  select row_number() over () as d, coalesce(lang, 'und') as lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents where text is not null
), pieces as (
  select lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from docs
), total as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by lang
), grams as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') as g from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from pieces cross join (select unnest([1, 2, 3, 4]) as m) where len(w) >= m)
), counted as (select lang, m, g, count(*) as f from grams group by lang, m, g having count(*) >= 30
), cuts as (
  select c.lang, c.m, c.g, c.f, k, array_to_string(string_split(c.g, ' ')[:k], ' ') as x, array_to_string(string_split(c.g, ' ')[k + 1:], ' ') as y
  from (select *, unnest(range(1, m)) as k from counted where m > 1) c
), scored as (
  select c.lang, c.m, c.g, c.f, c.k, p.f as l, q.f as r, (2000000::hugeint * c.f) // (p.f::hugeint + q.f) as s
  from cuts c join counted p on p.lang = c.lang and p.m = c.k and p.g = c.x join counted q on q.lang = c.lang and q.m = c.m - c.k and q.g = c.y
), lowest as (select * from (select *, row_number() over (partition by lang, m, g order by s, k) as nth from scored) where nth = 1
), inner_parts as (
  select lang, f, j, array_to_string(string_split(g, ' ')[i:i + j - 1], ' ') as part from (select lang, g, f, j, unnest(range(1, m - j + 2)) as i from (select *, unnest(range(2, m)) as j from counted where m > 2))
), covered as (select lang, j, part, max(f) as longer from inner_parts group by lang, j, part
), ranked as (
  select x.lang, row_number() over (partition by x.lang order by s desc, x.f desc, x.g) as rank, x.g as phrase, x.f as a, l, r, s as score
  from lowest x left join covered v on v.lang = x.lang and v.j = x.m and v.part = x.g where v.longer is null or 100::hugeint * v.longer < 80::hugeint * x.f
)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, cast(r.score as bigint) as score from ranked r join total t on t.lang = r.lang where rank <= 2000
"""
