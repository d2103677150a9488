"""DuckDB SQL of the queries that SQL can express in reasonable time.

Without SQL, and tested against brute force or round trips instead: op1 (sentence
grammar), op2 (a fitted model), op3 (an image codec), op6 (a search over greedy
cuts), op7 (alignments), op8 (a hash order of its own), op9 (a tokenizer).
"""

JACCARD = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as l from documents),
s as (
  select doc_id, case when len(l) = 0 then [] when len(l) < 5 then [array_to_string(l, ' ')] else list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) end as g from w),
e as (select doc_id, len(g) as n, unnest(g) as x from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
k as (select a, b from p where 100 * c >= 80 * (na + nb - c)),
v as (select a, b from k union all select b, a from k),
r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, v.b from r join v on v.a = r.other)
select s.doc_id, len(g)::bigint as n_shingles, m.component_id from s join (select doc_id, min(other) as component_id from r group by 1) m using (doc_id)
"""

CHAT = r"""
with c as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(14 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g')))::bigint as formatted_chars
from c group by 1
"""

SUFFIXES = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from (select doc_id, h, unnest(range(greatest(n - 49, 0))) as p from d)),
f as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by s) as m from w) where m < doc_id),
i as (select doc_id, p, sum(new) over (partition by doc_id order by p) as k from (select doc_id, p, (p - lag(p, 1, -1000) over (partition by doc_id order by p) > 50)::int as new from f)),
s as (select doc_id, k, min(p) as a, max(p) + 50 as b from i group by 1, 2),
x as (select doc_id, k, a, b, lag(b, 1, 0) over (partition by doc_id order by k) as z from s),
r as (select doc_id, sum(b - a)::bigint as removed, count(*) as spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' order by k) as head, max(b) as last from x join d using (doc_id) group by 1)
select doc_id, n as n_bytes, coalesce(removed, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(case when removed is null then h else head || substr(h, 2 * last + 1) end)) as kept_sha256 from d left join r using (doc_id)
"""
