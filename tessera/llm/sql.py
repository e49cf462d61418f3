"""DuckDB SQL for the queries of this subpackage that SQL can express in full."""

OP5 = """
with p as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as digest,
         strlen(coalesce(html, '')) as n
  from pages),
g as (select digest, max(page_id) as original from p where n >= 1000 group by digest having count(*) > 1)
select page_id, cast(n as bigint) as payload_bytes, p.digest as payload_digest,
       case when original is null or page_id = original then 'response' else 'revisit' end as record_type,
       case when original is not null and page_id <> original then original end as refers_to
from p left join g on p.digest = g.digest and p.n >= 1000
"""

OP8 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, cast(row_number() over w as integer) as rank, vec_id, score
from s window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 10
"""


def _op11(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds written out one after the other; vectors of one length."""
    nearest = """
a{r} as (
  select vec_id, part, entry, dist from (
    select p.vec_id, p.part, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as dist,
           row_number() over (partition by p.vec_id, p.part order by dist, c.entry) as place
    from p join c{r} c on p.part = c.part) where place = 1)"""
    better = """
s{r} as (
  select part, entry, pos, sum(x[pos]) as s, count(*) as n
  from a{r} join p using (vec_id, part), range(1, len(x) + 1) t(pos) group by all),
c{next} as (
  select c.part, c.entry, coalesce(m.x, c.x) as x from c{r} c left join (
    select part, entry, list(cast((s - ((s % n) + n) % n) // n as bigint) order by pos) as x from s{r} group by all) m using (part, entry))"""
    steps = ",".join(nearest.format(r=r) + (("," + better.format(r=r, next=r + 1)) if r < rounds else "") for r in range(rounds + 1))
    return f"""
with v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor({4096} * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, part, e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}] as x from v, range({parts}) t(part)),
c0 as (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x from p
       where vec_id in (select vec_id from v order by vec_id limit {entries})),{steps.replace(" as (", " as materialized (")},
b as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from c{rounds}),
o as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(dist)::bigint as error from a{rounds} group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from o join v using (vec_id), b
"""


OP11 = _op11()


OP12 = r"""
with d as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
w as (select doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as materialized (select lang, term, count(*) as c from w group by all having count(distinct doc) >= 10),
size as (select lang, count(*) as v, sum(c) as n from kept group by lang),
g as materialized (select distinct lang, source from d),
c as (select lang, source, term, count(*) as c from w semi join kept using (lang, term) group by all),
n as (select lang, source, sum(c) as n from c group by all),
p as materialized (
  select g.lang, g.source, k.term, coalesce(c.c, 0) as c,
         1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * s.v) as p,
         1 + (1000000000::hugeint * (k.c + 2)) // (s.n + 2 * s.v) as q
  from g join kept k on k.lang = g.lang join size s on s.lang = g.lang
  left join n on n.lang = g.lang and n.source = g.source
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as value
  from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
terms as (select lang, source, term as item, ((p - q) * (p - q)) // (p + q) as value from p where c > 0 and p > q),
every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all select lang, source, 'term', item, value from terms),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from every)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from ranked where part = 'pair' or rank <= 10
"""


OP13 = r"""
with d as materialized (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents),
i as (
  select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
iw as materialized (
  select distinct item, least(len(w), 10) as size, array_to_string(w[s + 1 : s + 10], ' ') as win
  from i, range(greatest(len(w) - 9, 1)) t(s) where len(w) > 0),
dw as materialized (
  select r, s, size, array_to_string(w[s + 1 : s + size], ' ') as win
  from d join (select distinct size from iw) on true, range(greatest(len(w) - size + 1, 0)) t(s)),
hit as materialized (select r, s, size, win from dw semi join iw using (size, win)),
covered as (select r, count(distinct pos) as n_hit from hit, range(s, s + size) t(pos) group by r),
found as (
  select r, count(*) as n_items, string_agg(item, ',' order by encode(item)) as ids
  from (select distinct r, item from hit join iw using (size, win)) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (r) left join found using (r)
"""
