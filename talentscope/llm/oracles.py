"""DuckDB oracles of the queries that SQL can express."""

from talentscope.llm.license_rules import RULES

# op3: rules, then the beta-binomial chain written out with CTEs
URL_FILTER = r"""
with parsed as (
  select page_id,
    translate(case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') else '' end,
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from (select page_id, coalesce(url, '') as url from pages)),
rules(action, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
urls as (select distinct host, path from parsed),
fits as (
  select u.host, u.path, arg_max(r.h || r.p, length(r.h || r.p)) as rule,
    arg_max(r.action, length(r.h || r.p)) as action
  from urls u join rules r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p)
  group by 1, 2),
lab as (select doc_id, case when avg(quality) < 0.5 then 1 else 0 end as bad from labels
  where quality is not null and doc_id is not null group by 1),
outcomes as (
  select host, count(*) as n, sum(bad) as k
  from (select host, try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]{1,18})(?:[./]|$)', 1), '') as bigint) as doc_id from parsed)
  join lab using (doc_id) group by 1),
named as (select host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as name from (select distinct host from parsed)),
split as (select host, string_split(name, '.') as parts from named),
tails as (select host, array_to_string(parts[-2:], '.') as last2, array_to_string(parts[-3:], '.') as last3, parts[-1] as last1 from split),
hosts as (
  select t.host, coalesce(n, 0) as n, coalesce(k, 0) as k,
    case when last2 in ('co.uk', 'com.au', 'co.jp', 'com.br') then last3 else last2 end as domain,
    case when last2 in ('co.uk', 'com.au', 'co.jp', 'com.br') then last2 else last1 end as suffix
  from tails t left join outcomes o on o.host = t.host),
domains as (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by 1, 2),
suffixes as (select suffix, sum(n) as n, sum(k) as k from domains group by 1),
levels as (select 1 as lv, n, k from suffixes union all select 2, n, k from domains union all select 3, n, k from hosts),
sums as (
  select lv, sum(n)::double as n, sum(k)::double as k, count(*) as u, sum(n::double * n) as nn, sum(k::double * k / n) as kk
  from levels where n > 0 group by 1),
rho as (
  select lv, k / n as p, case when u < 2 or k = 0 or k = n or n - nn / n <= u - 1 then null
    else (kk - k * k / n - k / n * (1 - k / n) * (u - 1)) / (k / n * (1 - k / n) * (n - nn / n - (u - 1))) end as r
  from sums),
conc as (
  select l.lv, coalesce(p, 0) as p, case when r > 0 then least(10000.0, greatest(1.0, 1 / r - 1)) else 10000.0 end as c
  from (values (1), (2), (3)) l(lv) left join rho using (lv)),
s as (select suffix, ((select p from conc where lv = 1) * (select c from conc where lv = 1) + k) / (n + (select c from conc where lv = 1)) as m from suffixes),
d as (select domain, suffix, (m * (select c from conc where lv = 2) + k) / (n + (select c from conc where lv = 2)) as m from domains join s using (suffix)),
post as (select host, m * (select c from conc where lv = 3) + k as a, (1 - m) * (select c from conc where lv = 3) + n - k as b
  from hosts join d using (domain, suffix)),
low as (select host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (b / (a + b)) / (a + b + 1)) as low from post)
select page_id, host, path, rule, coalesce(action, case when low > 0.35 then 'block' else 'allow' end) as verdict
from parsed join low using (host) left join fits using (host, path)
"""

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

# op4: windows of items joined with equally long windows of documents
DECONTAMINATE = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
wins as (
  select distinct item_id, m, w[i:i + m - 1] as win
  from (select item_id, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct m from wins),
dwin as (select r, m, i, w[i:i + m - 1] as win
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from d, sizes where len(w) >= m)),
met as (select r, m, i, item_id from dwin join wins using (m, win)),
hit as (select r, count(distinct p) as n from (select r, unnest(range(i, i + m)) as p from met) group by 1),
items as (select r, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from met group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(t.n, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from d left join hit h using (r) left join items t using (r)
"""

# op7: sizes and digests of the payloads, the smallest page of each larger payload
WARC = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as n, sha256(coalesce(html, '')) as dg from pages),
f as (select dg, min(page_id) as first_id from p where n >= 100 group by 1)
select page_id, n as payload_bytes, p.dg as payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from p left join f on p.dg = f.dg
"""

# op10: shingle sets, pairs that share a shingle, links, components
NGRAM_JOIN = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
sets as (select s, min(doc_id) as rep from (select doc_id, list_sort(s) as s from s) where len(s) > 0 group by 1),
tok as (select rep, len(s) as n, hash(unnest(s)) as t from sets),
met as (select a.rep as a, b.rep as b, a.n as na, b.n as nb, count(*) as x
  from tok a join tok b on a.t = b.t and a.rep < b.rep and 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) group by 1, 2, 3, 4),
links as (select a, b from met where 100 * x >= 75 * (na + nb - x)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on e.a = r.b),
comp as (select a as rep, least(a, min(b)) as c from reach group by 1)
select s.doc_id, len(s.s)::bigint as n_shingles, case when len(s.s) = 0 then s.doc_id else coalesce(c, sets.rep) end as component_id
from s left join sets on sets.s = list_sort(s.s) left join comp on comp.rep = sets.rep
"""

# op8: every 50-byte string as hex, its smallest document, covered bytes
SUFFIX_DEDUP = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
st as (select r, doc_id, i, substr(x, 2 * i + 1, 100) as g
  from (select r, doc_id, x, unnest(range(0, (length(x) // 2 - 49)::bigint)) as i from d where length(x) >= 100 and doc_id is not null)),
f as (select g, min(doc_id) as m from st group by 1 having count(*) > 1),
gone as (select r, i from st join f using (g) where doc_id > m),
runs as (
  select r, i, case when i - lag(i, 1, -100) over (partition by r order by i) > 50 then 1 else 0 end as fresh from gone),
spans as (select r, sum(fresh) over (partition by r order by i rows unbounded preceding) as k, i from runs),
cuts as (select r, k, min(i) as s, max(i) + 50 as e from spans group by 1, 2),
edges as (select r, s, e, lag(e, 1, 0) over (partition by r order by s) as p, row_number() over (partition by r order by s desc) as z from cuts),
kept as (
  select r, sum(e - s) as gone, count(*) as n,
    string_agg(substr(x, 2 * p + 1, 2 * (s - p)) || case when z = 1 then substr(x, 2 * e + 1) else '' end, '' order by s) as x
  from edges join d using (r) group by 1)
select doc_id, (length(d.x) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept.x, d.x))) as kept_sha256
from d left join kept using (r)
"""

# op12: postings of the items' terms, corpus statistics, ten best rows
RANKED_SEARCH = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select row_number() over () as q, item_id, {_WORDS} as w from benchmark),
sizes as (select r, doc_id, len(w)::bigint as n from d where len(w) > 0),
total as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes),
wanted as (select q, t, count(*) as times from (select q, unnest(w) as t from b) group by 1, 2),
tf as (select r, t, count(*)::bigint as tf from (select r, unnest(w) as t from d) semi join wanted using (t) group by 1, 2),
weights as (select t, floor(1000 * ln((2 * max(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by 1),
factor as (select r, doc_id, 25 + (75 * n * n_docs) // n_terms as m from sizes, total),
scores as (
  select q, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from wanted join weights using (t) join tf using (t) join factor using (r) group by 1, 2),
ranked as (
  select q, r, score, row_number() over (partition by q order by score desc, doc_id nulls last) as rank
  from scores join sizes using (r) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked join b using (q) join sizes using (r) where rank <= 10
"""


def _rule_rows() -> str:
    return ",\n  ".join(f"({i}, '{r.label}', {r.level}, {r.sure}, {list(r.needs)}, '{r.pattern}')"
                        for i, r in enumerate(RULES))


# op11: every rule's matches and the gaps between them give places; containment by a self join
LICENSE_SCAN = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
rules(rule, label, level, sure, needs, pattern) as (values
  {_rule_rows()}),
streams as (select r, w, ' ' || array_to_string(w, '  ') || ' ' as x from d where len(w) > 0),
hits as (
  select r, rule, label, level, sure, regexp_extract_all(x, pattern) as ms, regexp_split_to_array(x, pattern) as gaps
  from streams join rules on list_has_all(w, needs)),
places as (select *, unnest(range(1, len(ms) + 1)) as i from hits where len(ms) > 0),
spaces as (
  select r, rule, label, level, sure, array_to_string(gaps[1:i], '') || array_to_string(ms[1:i - 1], '') as before, ms[i] as m from places),
found as (
  select r, rule, label, level, sure, (length(before) - length(replace(before, ' ', ''))) // 2 as s,
    (length(m) - length(replace(m, ' ', ''))) // 2 as n from spaces),
kept as (
  select * from found a where level = 0 or not exists (
    select 1 from found o where o.r = a.r and o.level <= a.level and o.s <= a.s and o.s + o.n >= a.s + a.n
      and (o.level < a.level or o.n > a.n or (o.n = a.n and o.rule < a.rule)))),
base as (
  select r, count(*) as n, min(s) as lo, max(s) as hi, string_agg(distinct label, ',' order by label) as labels
  from found where level = 0 group by 1),
every as (select r, string_agg(distinct label, ',' order by label) as labels, max(sure) as sure from kept group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.lo::bigint as first_word, b.hi::bigint as last_word,
  coalesce(b.labels, '') as base_labels, coalesce(e.labels, '') as labels, coalesce(e.sure, 0) / 100.0 as score
from d left join base b using (r) left join every e using (r)
"""
