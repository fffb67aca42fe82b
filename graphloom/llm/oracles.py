"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .line_dedup import LEAST_PAGES, RATIO_PERCENT
from .mixing import LEAST_WEIGHT
from .sharding import SLOTS, lookup_table, shard_names

WORD = r"[^\x20\x09-\x0D]+"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as query_id, v as qv from v where vec_id % 50 = 0),
qx as (select query_id, generate_subscripts(qv, 1) as i, unnest(qv) as x from q),
vx as (select vec_id, generate_subscripts(v, 1) as i, unnest(v) as y from v),
s as (select query_id, vec_id, sum(x * y)::bigint as score from qx join vx using (i) where vec_id <> query_id group by all),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""

OP4 = f"""
with t as (select string_split('{",".join(map(str, lookup_table(shard_names(), SLOTS)))}', ',') as shards),
s as (select doc_id, (('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint % {SLOTS})::int as slot from documents)
select doc_id, slot, shards[slot + 1]::int as shard from s, t
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::bigint >> {s}) & 31)::int + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

OP5 = f"""
with p as (select page_id, sha1(coalesce(html, '')) as h, octet_length(encode(coalesce(html, ''))) as n from pages),
g as (select *, max(page_id) over (partition by h) as last from p)
select page_id, n::bigint as payload_bytes, {_BASE32} as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type,
  case when page_id = last then null else last end as refers_to
from g
"""

OP6 = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as solid, length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) as letters,
    (('0x' || substr(md5('17:' || doc_id), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from documents),
k as (
  select doc_id, source, size, -ln(u) / greatest({LEAST_WEIGHT}::double, case when solid > 0 then letters::double / solid else {LEAST_WEIGHT}::double end) as key from d),
s as (select source, sum(size)::bigint as source_size from k group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as n from s),
w as (select *, [5, 2, 1][(n % 3 + 1)::int]::double as w, 2 * source_size as cap from r),
l as (
  select *, (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / w, n rows between unbounded preceding and 1 preceding), 0)::double)
    / sum(w) over (order by cap / w, n rows between current row and unbounded following) as level from w),
t as (select source, source_size, least(cap::double, w * max(level) over ()) as target from l),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
p as (
  select k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    sum(k.size) over (partition by k.source order by k.key, k.doc_id rows unbounded preceding)::double as up_to
  from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target, (size * (epochs + case when rest > 0 and up_to - size / 2.0::double <= rest then 1 else 0 end))::bigint as taken from p
"""

OP7 = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
u as (select a, b from l union select b, a from l),
r as (select doc_id, doc_id as to_id from documents union select r.doc_id, u.b from r join u on u.a = r.to_id),
m as (select doc_id, min(to_id) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from documents d join m using (doc_id) left join n using (doc_id)
"""

OP9 = f"""
with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line from documents),
t as (select doc_id, source, line, trim(line, {_TRIM}) as core from l),
p as (select source, count(*) as pages from documents group by source),
b as (
  select t.source, core from t join p on t.source is not distinct from p.source where core <> ''
  group by t.source, core, pages having count(distinct doc_id) >= {LEAST_PAGES} and 100 * count(distinct doc_id) > {RATIO_PERCENT} * pages),
o as (select doc_id, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i, string_split(text, chr(10)) as ls from documents),
j as (select doc_id, i, ls[i] as line, trim(ls[i], {_TRIM}) <> '' as solid, b.core is not null as hit
  from o left join b on o.source is not distinct from b.source and trim(ls[i], {_TRIM}) = b.core),
a as (select doc_id, count(*) filter (solid) as n_lines, count(*) filter (hit) as n_dropped, string_agg(line, chr(10) order by i) filter (not hit) as kept from j group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, md5(coalesce(kept, '')) as text_md5
from documents d left join a using (doc_id)
"""

OP10 = rf"""
with w as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, {_TRIM}) <> '') as l from documents),
g as (
  select doc_id, unnest(range(1, len(w) - 1)) as i,
    unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) >= 3),
h as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
c as (select doc_id, count(distinct i + k) as n from h, range(3) x(k) group by doc_id),
m as (
  select w.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words, len(l) as n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) as lettered,
    len(regexp_extract_all(t, '\p{{Lu}}')) as upper, len(regexp_extract_all(t, '\p{{L}}')) as letters
  from w left join c using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or word_chars < 3 * n_words or word_chars > 10 * n_words
    or 2 * n_dup_lines > n_lines or 10 * lettered < 7 * n_words or 10 * upper > 4 * letters) as kept
from m
"""

OP12 = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
w as (select r, lang, source, unnest(terms) as term from d),
k as (select lang, term, count(*) as in_lang from w group by all having count(distinct r) >= 30),
l as (select lang, count(*) as v, sum(in_lang) as total from k group by lang),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
g as (select distinct lang, source from d),
s as (select g.lang, g.source, coalesce(sum(n), 0) as total from g left join c using (lang, source) group by all),
f as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (s.total + 5 * l.v)::hugeint as p,
    1 + (1000000000::hugeint * (k.in_lang + 5)) // (l.total + 5 * l.v)::hugeint as q
  from s join k using (lang) join l using (lang) left join c using (lang, source, term)),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(v.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from f x join f y using (lang, term) where x.source <> y.source group by all) v
    on v.lang = a.lang and v.source = a.source and v.item = b.source),
terms as (select lang, source, term as item, (p - q)::bigint as value from f where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, encode(item))::int as rank from pairs
union all
select * from (
  select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, encode(item))::int as rank from terms)
where rank <= 50
"""

OP13 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as i from d),
k as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from w),
m as (select s, min(doc_id) as least from k group by s having count(*) > 1),
hit as (select k.doc_id, k.i from k join m using (s) where m.least < k.doc_id),
run as (select *, case when i > coalesce(max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) + 50, -1) then 1 else 0 end as new from hit),
num as (select *, sum(new) over (partition by doc_id order by i) as n from run),
span as (select doc_id, n, min(i) as a, max(i) + 50 as b from num group by all),
sums as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, list(a order by a) as starts, list(b order by a) as ends from span group by doc_id)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(case when starts is null then h else
    array_to_string(list_transform(list_zip(list_prepend(0, ends), list_append(starts, length(h) // 2)), lambda z: substr(h, 2 * z[1] + 1, 2 * (z[2] - z[1]))), '') end)) as kept_sha256
from d left join sums using (doc_id)
"""

ORACLES = {"op1_topk_search": OP1, "op4_sharding": OP4, "op5_warc": OP5, "op6_mixing": OP6, "op7_near_dedup": OP7, "op9_line_dedup": OP9, "op10_quality": OP10, "op12_source_divergence": OP12, "op13_suffix_dedup": OP13}
