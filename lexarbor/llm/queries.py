"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarbor.llm import chat_format, collocations, decontaminate, exact_dedup, jaccard, language_id, minhash, mixing, passages, pii, spelling, toxicity, url_filter
from lexarbor.llm.common import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op4_exact_dedup"] = r"""
with d as (select doc_id, length(coalesce(text, '')) as size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as h from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size, row_number() over w = 1 as kept, h as text_sha256
from d window w as (partition by h order by size desc, doc_id nulls last)
"""


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


#: All pairs: for tables of some thousand documents.
SQL["op10_ngram_jaccard_join"] = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
sh as (select distinct r, array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ') as s from (select r, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from d where len(ws) > 0)),
n as (select r, count(*) as n from sh group by 1),
c as (select a.r as x, b.r as y, count(*) as inter from sh a join sh b on a.s = b.s and a.r < b.r group by 1, 2),
l as (select x, y from c join n p on p.r = x join n q on q.r = y where 5 * inter >= 4 * (p.n + q.n - inter)),
e as (select x, y from l union all select y, x from l),
reach as (select r, r as t from d union select reach.r, e.y from reach join e on e.x = reach.t),
named as (select reach.r, min(d.doc_id) as class_id from reach join d on d.r = reach.t group by 1)
select doc_id, class_id, coalesce(n_links, 0)::bigint as n_links from d join named using (r) left join (select x as r, count(*) as n_links from e group by 1) using (r)
"""


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


SQL["op5_mix_sources"] = r"""
with t as (select doc_id, coalesce(source, '') as s, source is null as none, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
             md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as digest from documents),
d as (select *, ('0x' || substr(md5(digest || ':' || (row_number() over (partition by none, s, digest) - 1)), 1, 8))::bigint as h from t),
src as (select none, s, sum(size)::bigint as source_size from d group by 1, 2),
ranked as (select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by none, s) - 1) % 3 + 1)::int] as w, row_number() over (order by none, s) as i from src),
ratio as (select *, 2.0::double * source_size::double as cap, 2.0::double * source_size::double / w as r from ranked),
level as (select *, ((sum(source_size) over ())::double * 1.5::double - 2.0::double * coalesce(sum(source_size) over (order by r, i rows between unbounded preceding and 1 preceding), 0)::double)
             / sum(w) over (order by r, i rows between current row and unbounded following) as l from ratio),
open as (select *, first_value(case when l <= r then l end ignore nulls) over (order by r, i rows between unbounded preceding and current row) as o from level),
goal as (select none, s, source_size, case when o is not null then w * o else cap end as target from open),
budget as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from goal),
sums as (select none, s, h, sum(size)::bigint as words from d group by 1, 2, 3),
running as (select u.*, sum(words) over (partition by u.none, u.s order by h) as upto, target - whole * source_size as left_over from sums u join budget b on u.none = b.none and u.s = b.s),
cut as (select none, s, coalesce(min(h) filter (where upto > left_over), max(h)) as edge from running group by 1, 2),
under as (select c.none, c.s, case when r.words < 2 * (r.left_over - (r.upto - r.words)) then c.edge + 1 else c.edge end as under from cut c join running r on r.none = c.none and r.s = c.s and r.h = c.edge)
select d.doc_id, d.size, b.source_size, b.target, (d.size * (b.whole + case when d.h < u.under then 1 else 0 end))::bigint as taken
from d join budget b on b.none = d.none and b.s = d.s join under u on u.none = d.none and u.s = d.s
"""


@query
def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL["op7_winnowing_decontamination"] = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
win as (select distinct item_id, least(len(ws), 13) as n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') as g from (select item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from b where len(ws) > 0)),
pos as (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from win) where len(ws) >= n),
hit as (select doc_id, i, p.n, item_id from (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as g from pos) p join win w on w.g = p.g and w.n = p.n),
words as (select doc_id, count(distinct i + j) as n_hit from (select doc_id, i, unnest(range(0, n)) as j from hit) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, item_id::varchar as x from hit) group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""


@query
def op3_toxicity_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("sentences")


@query
def op2_url_language_model_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _smoothed(k: int) -> str:
    """The models of order k: counts of the last k + 1 bytes, of their contexts, and Witten and Bell's mean with order k - 1."""
    low = f"join p{k - 1} l on l.g = right(n.g, {2 * k})" if k else "cross join (select 1::double / 256 as pa, 1::double / 256 as pr) l"
    mean = lambda c: f"case when n{c} > 0 then ({c} + t{c} * l.p{c}) / (n{c} + t{c}) else l.p{c} end as p{c}"
    return f"""n{k} as (select right(g, {2 * (k + 1)}) as g, sum(a)::double as a, sum(r)::double as r from counts group by 1),
c{k} as (select left(g, {2 * k}) as x, sum(a) as na, sum(r) as nr, sum((a > 0)::int)::double as ta, sum((r > 0)::int)::double as tr from n{k} group by 1),
p{k} as (select n.g, {mean("a")}, {mean("r")} from n{k} n join c{k} c on c.x = left(n.g, {2 * k}) {low}),
"""


SQL["op2_url_language_model_ratio"] = (
    r"""
with rest as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
split as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from rest),
j as (select *, case when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1' when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
  when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/' when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/' when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end as rule from split),
known as (select *, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' end as known, ('0x' || substr(md5(host || path), 1, 8))::bigint % 10 = 0 as left_out, lower(hex(encode(host || path))) as h from j),
u as (select host, path, known, left_out, h, count(*) as c from known group by all),
each as (select host, path, known, left_out, c, right('0000000000' || substr(h, 1, 2 * i), 12) as g from (select *, unnest(range(1, length(h) // 2 + 1)) as i from u)),
counts as (select g, coalesce(sum(c) filter (known = 'allow' and not left_out), 0) as a, coalesce(sum(c) filter (known = 'block' and not left_out), 0) as r from each group by 1),
"""
    + "".join(_smoothed(k) for k in range(url_filter.ORDER + 1))
    + rf"""scored as (select host, path, known, left_out, c, avg(ln(pa) - ln(pr)) as score from each join p{url_filter.ORDER} using (g) group by all),
bins as (select round(greatest(-20, least(20, score)) * 100)::int as bin, sum(case when known = 'allow' then c else 0 end) as a, sum(case when known = 'block' then c else 0 end) as r from scored where left_out and known is not null group by 1),
cuts as (select *, lag(bin) over (order by bin) as before, sum(a) over () as allowed, sum(r) over () as blocked,
  coalesce(sum(a) over (order by bin rows between unbounded preceding and 1 preceding), 0) as under_a, coalesce(sum(r) over (order by bin rows between unbounded preceding and 1 preceding), 0) as under_r from bins),
best as (select case when before is null then (bin - 0.5::double) / 100 else (bin + before)::double / 200 end as cut from cuts where allowed > 0 and blocked > 0 order by (allowed - under_a)::double / allowed + under_r::double / blocked desc, bin limit 1),
has as (select coalesce(sum(a), 0) > 0 and coalesce(sum(r), 0) > 0 as models from counts)
select page_id, k.host, k.path, rule, coalesce(k.known, case when not models then case when k.host || k.path = '' then 'block' else 'allow' end when score >= coalesce((select cut from best), 0) then 'allow' else 'block' end) as verdict
from known k cross join has left join scored s on s.host = k.host and s.path = k.path
"""
)


@query
def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    added = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    return chat_format.read_back(chat_format.windows(conversations.unionByName(added)))


SQL["op6_chat_windows"] = r"""
with recursive c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as n from c),
s as (select *, n = 0 and role = 'system' as is_system, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 2 as tokens,
  4 + length(url_encode(role)) + 2 + length(replace(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '##', '#\#'), '</turn>', '<\/turn>')) + 8 as chars from t),
b as (select *, sum(case when is_system then 0 else tokens end) over (partition by conv_id order by n) - case when is_system then 0 else tokens end as begin,
  max(case when is_system then tokens else 0 end) over (partition by conv_id) as system_tokens, max(case when is_system then chars else 0 end) over (partition by conv_id) as system_chars from s),
o as (select coalesce(conv_id, -1) as k, * from b where not is_system),
-- the budget's rule: of the turns before a window's first one as many as 96 tokens hold and leave room for it, then turns while all of them fit 512 tokens
rep as (select i.k, i.n as own, i.system_tokens, min(j.n) as first, min(j.begin) as first_begin from o i join o j on j.k = i.k and j.n <= i.n and (j.n = i.n or i.begin - j.begin <= least(96, 512 - i.system_tokens - i.tokens)) group by 1, 2, 3),
reach as (select rep.k, rep.own, case when rep.own = l.n then rep.own else first end as first, min(x.n) as next from rep join (select k, min(n) as n from o group by 1) l on l.k = rep.k
  left join o x on x.k = rep.k and x.n > rep.own and rep.system_tokens + x.begin + x.tokens - rep.first_begin > 512 group by 1, 2, 3),
win as (select r.* from reach r join (select k, min(n) as n from o group by 1) l on l.k = r.k and l.n = r.own union all select r.* from win join reach r on r.k = win.k and r.own = win.next),
chars as (select win.k, win.own, sum(o.chars) as chars from win join o on o.k = win.k and o.n >= win.first and (win.next is null or o.n < win.next) group by 1, 2),
size as (select b.conv_id, greatest(1, coalesce(any_value(c.n), 0)) * max(b.system_chars) + coalesce(any_value(c.chars), 0) as formatted_chars
  from b left join (select k, count(*) as n, sum(chars) as chars from chars group by 1) c on c.k = coalesce(b.conv_id, -1) group by 1)
select t.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '')) as loss_sha256, any_value(formatted_chars)::bigint as formatted_chars
from t join size using (conv_id) group by 1
"""


@query
def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


#: Base spans. What patterns discover is beyond SQL (an iteration of unknown length): equal wherever no pattern is sure enough to add any.
SQL["op1_pii_bootstrap"] = r"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
p(k, kind) as (values (1, 'email'), (2, 'ip'), (3, 'card'), (4, 'phone')),
f as (select r, 1 as k, regexp_extract_all(text, EMAIL) as ms, string_split_regex(text, EMAIL) as gaps from t union all select r, 2, regexp_extract_all(text, IP), string_split_regex(text, IP) from t
  union all select r, 3, regexp_extract_all(text, CARD), string_split_regex(text, CARD) from t union all select r, 4, regexp_extract_all(text, PHONE), string_split_regex(text, PHONE) from t),
m as (select r, k, unnest(range(1, len(ms) + 1)) as i, ms, gaps from f),
s as (select r, k, ms[i] as v, regexp_replace(ms[i], '[^0-9]', '', 'g') as d, list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in ms[1:i - 1]]), 0) as b from m),
ok as (select r, k, b, b + length(v) as e from s where case k when 1 then true when 2 then len([x for x in string_split(v, '.') if length(ltrim(x, '0')) > 3 or coalesce(try_cast(ltrim(x, '0') as int), 0) > 255]) = 0
  when 3 then length(d) between 16 and 19 and list_sum([case when (length(d) - i) % 2 = 0 then substr(d, i, 1)::int when substr(d, i, 1)::int > 4 then substr(d, i, 1)::int * 2 - 9 else substr(d, i, 1)::int * 2 end for i in range(1, least(length(d), 19) + 1)]) % 10 = 0
  else length(d) between 8 and 15 end),
told as (select r, string_agg(kind || ':' || b::bigint || ':' || e::bigint, ',' order by k, b) as spans, count(*) filter (k = 1) as n1, count(*) filter (k = 2) as n2, count(*) filter (k = 3) as n3, count(*) filter (k = 4) as n4 from ok join p using (k) group by 1)
select doc_id, coalesce(n1, 0) as n_email, coalesce(n2, 0) as n_ip, coalesce(n3, 0) as n_card, coalesce(n4, 0) as n_phone, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans, 0::bigint as n_added from t left join told using (r)
"""
for _name, _find in (("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("IP", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"), ("CARD", r"[0-9](?:[\x20-]?[0-9])+"), ("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]")):
    SQL["op1_pii_bootstrap"] = SQL["op1_pii_bootstrap"].replace(_name, f"'{_find}'")


@query
def op8_language_id_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(read(spark, sf_dir, "documents"))


@query
def op9_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared(read(spark, sf_dir, "documents"))


@query
def op11_minhash_star_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(read(spark, sf_dir, "documents"))


#: All pairs that share a shingle: for tables of some thousand documents.
SQL["op11_minhash_star_components"] = r"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sh as (select distinct r, array_to_string(ws[i : i + least(len(ws), 3) - 1], ' ') as s from (select r, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from d where len(ws) > 0)),
n as (select r, count(*) as n from sh group by 1),
c as (select a.r as x, b.r as y, count(*) as inter from sh a join sh b on a.s = b.s and a.r < b.r group by 1, 2),
l as (select x, y from c join n p on p.r = x join n q on q.r = y where 100 * inter >= 85 * (p.n + q.n - inter)),
e as (select x, y from l union all select y, x from l),
reach as (select r, r as t from d union select reach.r, e.y from reach join e on e.x = reach.t),
named as (select reach.r, min(d.doc_id) as component_id from reach join d on d.r = reach.t group by 1)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id is not distinct from component_id as kept from d join named using (r) left join n using (r)
"""


@query
def op12_spelling_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def _crc_table() -> list[int]:
    """The remainders of all bytes by the reversed polynomial of CRC-32."""
    out = list(range(256))
    for _ in range(8):
        out = [(c >> 1) ^ (0xEDB88320 * (c & 1)) for c in out]
    return out


SQL["op12_spelling_neighbourhoods"] = rf"""
with recursive run as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
once as (select id, run, count(*) as c, hex(encode(id || ':' || run)) as x from run where length(run) >= 6 group by 1, 2),
crc as (select run, c, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [('0x' || substr(x, 2 * i - 1, 2))::bigint for i in range(1, length(x) // 2 + 1)]), lambda s, b: xor(({_crc_table()})[(xor(s, b) & 255) + 1], s >> 8))) as h from once),
v as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(c)::bigint as n from crc group by 1 having length(word) >= 6 and sum(c) >= 5),
letters as (select array_agg(distinct c order by c) as abc from (select unnest(string_split(word, '')) as c from v)),
made as (select word, n, unnest([substr(word, 1, i) || substr(word, i + 2) for i in range(0, length(word))]) as other from v
  union all select word, n, substr(word, 1, i) || c || substr(word, i + 2) from (select word, n, i, unnest(abc) as c from (select word, n, unnest(range(0, length(word))) as i from v), letters)
  union all select word, n, substr(word, 1, i) || c || substr(word, i + 1) from (select word, n, i, unnest(abc) as c from (select word, n, unnest(range(0, length(word) + 1)) as i from v), letters)),
near as (select distinct m.word, m.n, m.other, v.n as other_n from made m join v on v.word = m.other where m.word <> m.other),
best as (select word, count(*) as n_near, max(other_n) as most from near group by 1),
form as (select near.word, min(other) as form, any_value(most) as form_n from near join best on best.word = near.word and other_n = most where most >= 5 * n group by 1),
path as (select word, form as head, 1 as step from form union all select path.word, form.form, step + 1 from path join form on form.word = path.head),
ends as (select word, arg_max(head, step) as root from path group by 1)
select v.word, form, coalesce(root, v.word) as root, n, coalesce(n_near, 0) as n_near, form_n from v left join best using (word) left join form using (word) left join ends using (word)
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


SQL["op13_collocations"] = r"""
with p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
n as (select lang, sum(len(ws))::bigint as n from p group by 1),
g as (select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase, count(*) as f from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from p, (select unnest(range(1, 6)) as k)) group by all having count(*) >= 100),
cut as (select g.lang, g.phrase, g.k, g.f as a, cut, l.f as l, r.f as r, n.n, 1000::hugeint * g.f * n.n // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, k)) as cut from g where k > 1) g join n on n.lang = g.lang join g l on l.lang = g.lang and l.phrase = array_to_string(string_split(g.phrase, ' ')[1:cut], ' ') join g r on r.lang = g.lang and r.phrase = array_to_string(string_split(g.phrase, ' ')[cut + 1:], ' ')),
low as (select * from cut qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
kept as (select * from low c where not exists (select 1 from low e where e.lang = c.lang and e.k > c.k and 100 * e.a >= 100 * c.a and contains(' ' || e.phrase || ' ', ' ' || c.phrase || ' ')))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score from kept qualify rank <= 2000
"""
