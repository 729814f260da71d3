"""SQL for the queries that it can express, for another engine on the same tables."""

from __future__ import annotations

from weirstone.llm import chat, licenses

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select * from r where rank <= 10
"""

DECONTAMINATE = f"""
with d as (select doc_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} as w from documents),
i as (select item_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} as v from benchmark),
iw as (select distinct item_id, n, array_to_string(v[k:k + n - 1], ' ') as win from (select *, least(10, len(v)) as n from i where len(v) > 0), unnest(range(1, len(v) - n + 2)) t(k)),
dw as (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as win from d, (select distinct n from iw), unnest(range(1, len(w) - n + 2)) t(k)),
h as (select doc_id, k, n, item_id from dw join iw using (win, n)),
p as (select doc_id, count(distinct p) as n_hit from h, unnest(range(k, k + n)) t(p) group by doc_id),
s as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from h group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join p using (doc_id) left join s using (doc_id)
"""

NEAR_DUPLICATES = f"""
with recursive d as (select doc_id, {_words(r"[^\x20\x09-\x0D]+")} as w from documents),
x as (select distinct doc_id, array_to_string(w[k:k + least(3, len(w)) - 1], ' ') as g from d, unnest(range(1, len(w) - least(3, len(w)) + 2)) t(k) where len(w) > 0),
n as (select doc_id, count(*) as n from x group by doc_id),
l as (select a.doc_id as a, b.doc_id as b from x a join x b on a.g = b.g and a.doc_id <> b.doc_id join n na on na.doc_id = a.doc_id join n nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r as (select doc_id as a, doc_id as b from d union select r.a, l.b from r join l on l.a = r.b),
c as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from d left join n using (doc_id) join c using (doc_id)
"""

#: What stands for an escape: one character more for each control string. (The other engine's patterns can't look ahead, and its white space lacks one character.)
_CONTROL = r"[<\[]\\*(?:" + "|".join(chat.CONTROL_RESTS) + ")"
_PIECE = chat.PIECE.replace(r"\s", r"\t\n\x0B\f\r ")
_ESCAPED = "length({0}) + len(regexp_extract_all({0}, '" + _CONTROL + "'))"
_MARKS = len(chat.TURN + chat.SAY + chat.END)

# Windows of a block: line (turns just before it, own turns), prefix sums of tokens u and of formatted characters c, greedy starts.
# Blocks that repeat turn numbers to more than chat.BLOCK_ROWS rows are cut by hashes, which is left out here.
CHAT = f"""
with recursive t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as said from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o as (select *, floor(turn / {chat.BLOCK_TURNS}) as b, len(regexp_extract_all(said, '{_PIECE}')) + {chat.MARKER_TOKENS} as tok,
  {_MARKS} + {_ESCAPED.format("role")} + {_ESCAPED.format("said")} as chars, row_number() over (partition by conv_id order by turn nulls first, role, said) as k from t),
whole as (select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || said || chr(10), '' order by k)) as turns_sha256,
  coalesce(string_agg(said, '' order by k) filter (role = 'assistant'), '') as loss from o group by conv_id),
blocks as (select conv_id, b, row_number() over (partition by conv_id order by b nulls first) = 1 as leads from (select distinct conv_id, b from o)),
line as (select conv_id, b, 1 as own, k, tok, chars from o
  union all select conv_id, b + 1, 0, k, tok, chars from o where (turn % {chat.BLOCK_TURNS} + {chat.BLOCK_TURNS}) % {chat.BLOCK_TURNS} >= {chat.BLOCK_TURNS - chat.HISTORY_TURNS}),
sums as (select l.*, sum(tok) over w as u, sum(chars) over w as c from line l window w as (partition by conv_id, b order by own, k)),
lists as (select conv_id, b, [0] || list(u order by own, k) as u, [0] || list(c order by own, k) as c, count(*) as n, count(*) filter (own = 0) as late from sums group by conv_id, b having max(own) = 1),
held as (select l.*, h.tok is not null and x.leads as leads, h.tok is not null and not x.leads as sent, coalesce(h.tok, 0) as sys, coalesce(h.chars, 0) as sys_chars
  from lists l join blocks x on l.conv_id is not distinct from x.conv_id and l.b is not distinct from x.b
  left join (select * from o where k = 1 and role = 'system') h on h.conv_id is not distinct from l.conv_id),
walk as (select *, late as s from held
  union all select * replace (list_filter(range(s + 1, n), lambda k: u[k + 2] - u[s + 1] > greatest(2048 - 512 - sys, 1))[1] as s) from walk where s is not null),
spans as (select *, coalesce(lead(s) over (partition by conv_id, b order by s), n) as e from walk where s is not null),
fits as (select *, case when sys + u[e + 1] - u[s + 1] > 2048 - 512 then 2048 - sys - (u[e + 1] - u[s + 1]) else 512 end as room from spans),
made as (select *, s - len(list_filter(range(cast(leads as int), s), lambda k: u[s + 1] - u[k + 1] <= room)) as p from fits),
f as (select conv_id, sum(case when sent or (leads and s > 0) then sys_chars else 0 end + c[e + 1] - c[p + 1]) as formatted_chars from made group by conv_id)
select w.conv_id, n_turns, turns_sha256, cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars
from whole w join f on w.conv_id is not distinct from f.conv_id
"""

_TEMPLATES = ", ".join(f"({t}, '{x.label}', {x.base}, {x.drift}, {x.words})" for t, x in enumerate((*licenses.PHRASES, *licenses.NOTICES)))

LICENSES = f"""
with d as (select row_number() over () as r, doc_id, {_words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} as w from documents),
p as (select *, len(v) - {licenses.GRAM - 1} as grams from (values {_TEMPLATES}) x(t, label, base, drift, v)),
pg as (select p.*, j, array_to_string(v[j + 1:j + {licenses.GRAM}], ' ') as gram from p, unnest(range(0, grams)) y(j)),
dg as (select r, i, array_to_string(w[i + 1:i + {licenses.GRAM}], ' ') as gram from d, unnest(range(0, len(w) - {licenses.GRAM - 1})) y(i)),
hits as (select r, t, label, base, drift, grams, i, j, i - j as diagonal from dg join pg using (gram)),
diagonals as (select distinct r, t, drift, diagonal from hits),
apart as (select *, coalesce(diagonal - lag(diagonal) over (partition by r, t order by diagonal) > drift, true) as new from diagonals),
numbered as (select *, sum(cast(new as int)) over (partition by r, t order by diagonal) as span from apart),
spans as (select r, t, span, any_value(label) as label, any_value(base) as base, min(i) as first, count(distinct j) / any_value(grams) as score
  from hits join numbered using (r, t, diagonal) group by r, t, span),
kept as (select * from spans where not base or score = 1),
found as (select r, count(*) filter (base) as n_base, min(first) filter (base) as first_word, max(first) filter (base) as last_word, max(score) as score,
  string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) filter (base or score >= 0.8) as labels from kept group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from d left join found using (r)
"""

#: Starts follow each other by recursion: the next one is the next hard start, or the first click beyond the longest length.
SESSIONS = """
with recursive c as (select distinct click_id, client_id, epoch_us(ts) as us, epoch_us(arrived_at) as arrived, kind, value from clicks where click_id is not null and client_id is not null and ts is not null),
t as (select client_id, click_id, us, coalesce(kind = 'purchase' and value >= 60, false) as final, cast(coalesce(floor(100 * value + 0.5), 0) as bigint) as cents,
  row_number() over (partition by client_id order by us, click_id) as k from c where coalesce(arrived - us <= 3600000000, true)),
h as (select *, coalesce(lag(final) over w or us - lag(us) over w >= 1800000000, true) as hard from t window w as (partition by client_id order by k)),
n as (select client_id, k, least(min(case when hard then k end) over (partition by client_id order by k rows between 1 following and unbounded following),
  min(k) over (partition by client_id order by us range between 7200000001 following and unbounded following)) as to_k from h),
s as (select client_id, k from h where k = 1 union all select client_id, to_k from s join n using (client_id, k) where to_k is not null),
b as (select client_id, k as lo, lead(k) over (partition by client_id order by k) as hi from s),
g as (select client_id, lo, any_value(hi) as hi, min(us) as start_us, max(us) as end_us, count(*) as n_clicks, cast(sum(cents) as bigint) as value_cents,
  arg_min(click_id, k) as session_id, arg_max(final, k) as ended, sha256(string_agg(cast(click_id as varchar), ',' order by k)) as path_sha256
  from b join t using (client_id) where k >= lo and (hi is null or k < hi) group by client_id, lo),
o as (select g.*, t.us as next_us from g left join t on t.client_id = g.client_id and t.k = g.hi),
l as (select o.client_id, o.lo, count(*) as n_late from o join c on c.client_id = o.client_id and c.arrived - c.us > 3600000000 and c.us >= o.start_us and (o.next_us is null or c.us < o.next_us) group by o.client_id, o.lo)
select o.client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) as n_late, value_cents,
  case when ended then 'end' when next_us is null then 'none' when next_us - end_us >= 1800000000 then 'gap' else 'length' end as closed_by, path_sha256
from o left join l on l.client_id = o.client_id and l.lo = o.lo
"""

#: All kept terms of a language for each of its sources, and all pairs of these.
DIVERGENCE = f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_words(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")} as w from documents),
x as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as lang_n from x group by lang, term having count(distinct r) >= 10),
v as (select lang, cast(count(*) as hugeint) as v, cast(sum(lang_n) as hugeint) as lang_total from kept group by lang),
c as (select lang, source, term, count(*) as n from x join kept using (lang, term) group by lang, source, term),
g as (select d.lang, d.source, coalesce(any_value(n), 0) as total from (select distinct lang, source from d) d left join (select lang, source, cast(sum(n) as hugeint) as n from c group by lang, source) s on s.lang = d.lang and s.source = d.source group by d.lang, d.source),
p as (select g.lang, g.source, k.term, coalesce(n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 2) // (total + 2 * v) as p, 1 + 1000000000::hugeint * (lang_n + 2) // (lang_total + 2 * v) as q
  from g join v using (lang) join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as bigint) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // (p + q) as bigint) as value from p where n > 0 and p > q),
r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10
"""

NEAR_VECTORS = """
with recursive v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
u as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.r as a, b.r as b from u a join u b on a.r <> b.r and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
n as (select a as r, count(*) as n_links from l group by a),
c as (select r as a, r as b from v union select c.a, l.b from c join l on l.a = c.b),
m as (select c.a as r, min(v.vec_id) as component_id from c join v on v.r = c.b group by c.a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, coalesce(vec_id = component_id, false) as kept from v join m using (r) left join n using (r)
"""
