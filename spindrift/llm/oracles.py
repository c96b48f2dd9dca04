"""Brute-force DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from . import linededup

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: Transitive closure of links; the least node reached names a component.
_REACH = "reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a), comp as (select a, least(a, min(b)) as c from reach group by a)"

VECTORS = f"""with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where vec_id is not null and embedding is not null),
n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as r from v where list_bool_and(list_transform(e, lambda x: x is not null and isfinite(x)))),
links as (select a.vec_id as a, b.vec_id as b from n a, n b where a.vec_id <> b.vec_id and a.r > 0 and b.r > 0 and len(a.e) = len(b.e) and list_inner_product(a.e, b.e) / (a.r * b.r) >= 0.9),
{_REACH}
select m.vec_id, (select count(*) from links l where l.a = m.vec_id) as n_links, coalesce(c, m.vec_id) as component_id, coalesce(c, m.vec_id) = m.vec_id as kept from embeddings m left join comp on a = m.vec_id"""

SHINGLES = f"""with recursive w as (select doc_id, {_SPLIT.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
u as (select doc_id, len(s) as n, unnest(s) as g from s),
links as (select x.doc_id as a, y.doc_id as b from u x join u y on x.g = y.g and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
{_REACH}
select doc_id, len(s)::bigint as n_shingles, coalesce(c, doc_id) as component_id from s left join comp on a = doc_id"""

SUBSTRINGS = f"""with w as (select doc_id, {_SPLIT.format("coalesce(text, '')")} as w from documents),
x as (select doc_id, unnest(range(1, len(w) - 48)) as i, w from w where len(w) >= 50),
k as (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as k from x),
f as (select k, min(doc_id) as first from k group by k),
gone as (select distinct doc_id, i + j as p from k join f using (k), (select unnest(range(50)) as j) where doc_id > first),
p as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from w),
t as (select p.doc_id, count(g.p) as n_removed, string_agg(word, ' ' order by p.p) filter (where g.p is null) as kept from p left join gone g on p.doc_id = g.doc_id and p.p = g.p group by p.doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join t using (doc_id)"""

#: Every window of a document that shares a shingle with an item (others have similarity 0).
LEAKS = f"""with d as (select doc_id, {_SPLIT.format("lower(coalesce(text, ''))")} as w from documents),
b as (select item_id, w, len(w) as n, least(5, len(w)) as k from (select item_id, {_SPLIT.format("lower(coalesce(text, ''))")} as w from benchmark) where len(w) > 0),
bg as (select item_id, n, k, array_to_string(w[i : i + k - 1], ' ') as g, count(*) as c from (select *, unnest(range(1, n - k + 2)) as i from b) group by all),
ks as (select distinct k from b),
dg as (select doc_id, k, array_to_string(w[i : i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks)),
pairs as (select distinct doc_id, item_id, n, bg.k from dg join bg using (k, g)),
win as (select doc_id, item_id, n, k, s, w[s + 1 : s + n] as v from (select p.*, d.w, unnest(range(0, greatest(1, len(d.w) - p.n + 1))) as s from pairs p join d using (doc_id))),
wg as (select doc_id, item_id, n, s, len(v) as m, array_to_string(v[i : i + k - 1], ' ') as g, count(*) as c from (select *, unnest(range(1, greatest(1, len(v) - k + 1) + 1)) as i from win) group by all),
i as (select w.doc_id, w.item_id, s, m, w.n, sum(least(w.c, coalesce(bg.c, 0))) as shared, sum(w.c) as mine from wg w left join bg on w.item_id = bg.item_id and w.g = bg.g group by all),
sim as (select doc_id, i.item_id, s, m, shared / (mine + t.total - shared) as similarity from i join (select item_id, sum(c) as total from bg group by item_id) t on t.item_id = i.item_id),
best as (select *, row_number() over (partition by doc_id, item_id order by similarity desc, s) as r from sim where similarity >= 0.75)
select doc_id, item_id, s::int as start, m::int as n_words, similarity::double as similarity from best where r = 1"""

ORACLES = {"op1_nn_descent": VECTORS, "op3_ngram_join": SHINGLES, "op5_substrings": SUBSTRINGS, "op6_decontamination": LEAKS, "op9_line_dedup": linededup.oracle()}
