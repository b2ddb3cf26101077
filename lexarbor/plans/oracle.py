"""The queries in DuckDB's SQL, written from their definitions."""

from __future__ import annotations

import re

from lexarbor.functions import text as tx
from lexarbor.functions import vocabulary
from lexarbor.operators import dedup, generation, prompts
from lexarbor.operators.prompts import PROMPTS
from lexarbor.plans import fixtures as fx

T975 = 2.7764451051977987  # t quantile of four degrees of freedom


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{tx.SPACE}+'), lambda w: w <> '')"


def _clean(x: str, key: str, source: str, table: str) -> str:
    t = f"lower({x})"
    for pattern, to in ((tx.HTML_TAG, " "), (tx.VIDEO_URL, tx.PLACEHOLDERS["video"]), (tx.URL, tx.PLACEHOLDERS["url"]), (tx.EMAIL, tx.PLACEHOLDERS["email"]), (tx.PHONE, tx.PLACEHOLDERS["phone"])):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return f"""select {key}, source, case when x is null or x = '' or length(t) <= 10 then 'empty' when len(string_split(t, ' ')) <= 400 then t
      else array_to_string(string_split(t, ' ')[1:400], ' ') end as clean_text
      from (select {key}, {source} as source, {x} as x, trim(regexp_replace({t}, '{tx.SPACE}+', ' ', 'g'), ' ') as t from {table})"""


CLEAN_DOCS = _clean("text", "doc_id", "source", "documents")
HASH = f"md5(array_to_string({_words('lower(coalesce(text, chr(32)))')}, ' '))"
TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), '{tx.WORD}+')"
LONG_TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), '{tx.WORD}{{2,}}')"
def _grams(source: str) -> str:
    return f"""(select distinct_on, gram, count(*) as tf from (select distinct_on, unnest(case when length(w) < 3 then [w] else list_concat(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)),
  case when length(w) >= 4 then list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) else [] end) end) as gram
  from (select distinct_on, ' ' || unnest({_words("lower(coalesce(text, ''))")}) || ' ' as w from {source})) group by all)"""


U = "('0x' || substr(md5('{seed}:' || {key}), 1, 8))::bigint / 4294967296.0::double"
PERMUTATIONS = "(values " + ", ".join(f"({i}, {a}::bigint, {b}::bigint)" for i, (a, b) in enumerate(dedup.coefficients())) + ") p(i, a, b)"
BANDS = f"""hashes as (select distinct doc_id, ('0x' || substr(md5(t), 1, 8))::bigint % {dedup.PRIME} as h from (select doc_id, unnest({TOKENS}) as t from documents)),
minima as (select doc_id, i, min((a * h + b) % {dedup.PRIME}) as m from hashes, {PERMUTATIONS} group by all),
bands as (select doc_id, (i // {dedup.ROWS})::int as band, md5(string_agg(m::varchar, ',' order by i)) as bucket from minima group by all)"""


def _bigrams(where: str) -> str:
    return f"select row_number() over (order by n desc, term) as rank, term, n from (select t[i] || ' ' || t[i + 1] as term, count(*) as n from (select {LONG_TOKENS} as t, unnest(range(1, len(t))) as i from documents {where}) group by 1) qualify rank <= 50"


def _p(t: str) -> str:
    return f"greatest(0, 1 - abs({t}) / sqrt(4 + {t} * {t}) * (1 + 2 / (4 + {t} * {t})))"


CONSTANT = "case metric " + " ".join(f"when '{k}' then {v}::double" for k, v in fx.CONSTANTS.items()) + " end"
DELTAS = f"m as ({fx.METRICS_SQL}), delta as (select a.condition, a.metric, a.seed, a.value - b.value as d from m a join m b using (metric, seed) where a.condition <> '{fx.BASE}' and b.condition = '{fx.BASE}')"
TEST = "select condition, metric, avg(d) as mean_difference, case when stddev_samp(d) > 0 then avg(d) / (stddev_samp(d) / sqrt(count(*))) end as t from {rows} group by all"
PRICES = "(values " + ", ".join(f"('{m}', {a}::double, {b}::double)" for m, (a, b) in generation.PRICES.items()) + ") p(model, price_in, price_out)"


def _choice(pool: list[str], seed: str) -> str:
    return f"{pool}[(floor({U.format(seed=seed, key='record_id')} * {len(pool)}) + 1)::int]"


def _prompt(label: str, seed: int) -> str:
    p = PROMPTS[label]
    out = f"'{p.template}'"
    drawn = {n: _choice(pool, f"{seed}-{n}") for n, pool in p.choices.items()}
    drawn |= {n: f"array_to_string(list_transform(list_sort(list_transform({pool}, lambda x: md5('{seed}-{n}:' || record_id || ':' || x) || x))[1:{k}], lambda x: substr(x, 33)), ', ')" for n, (pool, k) in p.several.items()}
    drawn |= {n: f"({a} + floor({U.format(seed=f'{seed}-{n}', key='record_id')} * {b - a + 1}))::int::varchar" for n, (a, b) in p.numbers.items()}
    for n, value in drawn.items():
        out = f"replace({out}, '{{{n}}}', {value})"
    return out


def _grammar(template: str, fields: dict, seed: int, key: str) -> str:
    """The text of a grammar for a key, told again from its definition."""
    u = lambda name: U.format(seed=f"{seed}-{name}", key=key)

    def told(name: str) -> str:
        f = fields[name]
        if isinstance(f, prompts.Several):
            return f"array_to_string(list_transform(list_sort(list_transform({f.pool}, lambda x: md5('{seed}-{name}:' || {key} || ':' || x) || x))[1:{f.k}], lambda x: substr(x, 33)), '{f.between}')"
        if isinstance(f, prompts.Number):
            return f"(({f.low} + floor({u(name)} * {f.high - f.low + 1}))::int * {f.unit})::varchar"
        if isinstance(f, list):
            return f"[{', '.join(text(x) for x in f)}][floor({u(name)} * {len(f)})::int + 1]"
        whens = " ".join(f"when '{v}' then {text(t)}" for v, t in f.texts.items())
        return f"case {fields[f.of]}[floor({u(f.of)} * {len(fields[f.of])})::int + 1] {whens} else {text(f.otherwise)} end"

    def text(t: str) -> str:
        return "(" + " || ".join(told(p) if i % 2 else f"'{p}'" for i, p in enumerate(re.split(r"\{(\w+)\}", t))) + ")"

    return text(template)


def _weighted() -> str:
    total, out, names = 0.0, "case", list(generation.MODEL_WEIGHTS)
    whole = sum(generation.MODEL_WEIGHTS.values())
    for name, w in generation.MODEL_WEIGHTS.items():
        total += w
        out += f" when {U.format(seed=5, key='doc_id')} * {whole!r}::double < {total!r}::double then '{name}'"
    return out + f" else '{names[-1]}' end"


def _self_bleu(source: str, group: str, key: str) -> str:
    return f"""words as (select {group} as g, {key} as k, {_words("lower(coalesce(text, ''))")} as w from {source}),
grams as (select g, k, o, array_to_string(w[i : i + o - 1], ' ') as gram from (select g, k, w, o, unnest(range(1, len(w) - o + 2)) as i from words, (values (1), (2), (3), (4)) t(o) where len(w) >= o)),
counts as (select g, k, o, gram, count(*) as c from grams group by all),
others as (select *, case when k = first_value(k) over w then coalesce(nth_value(c, 2) over w, 0) else first_value(c) over w end as other from counts
  window w as (partition by g, o, gram order by c desc, k rows between unbounded preceding and unbounded following)),
clipped as (select g, k, o, sum(least(c, other)) as m, sum(c) as total from others group by all),
sized as (select g, len(w) as l, count(*) as n from words group by all),
refs as (select g, l, case when n > 1 then l else (select min_by(s.l, (abs(s.l - z.l), s.l)) from sized s where s.g = z.g and s.l <> z.l) end as ref from sized z),
scores as (select words.g, words.k, case when coalesce(max(m) filter (where o = 1), 0) = 0 then 0.0::double else
   (case when len(any_value(w)) > any_value(ref) then 1.0::double else exp(1 - any_value(ref) / len(any_value(w))::double) end)
   * exp((ln(max(m) filter (where o = 1) / max(total) filter (where o = 1)::double)
   + ln((case when coalesce(max(m) filter (where o = 2), 0) = 0 then 0.1::double else max(m) filter (where o = 2) end) / greatest(1, coalesce(max(total) filter (where o = 2), 0)))
   + ln((case when coalesce(max(m) filter (where o = 3), 0) = 0 then 0.1::double else max(m) filter (where o = 3) end) / greatest(1, coalesce(max(total) filter (where o = 3), 0)))
   + ln((case when coalesce(max(m) filter (where o = 4), 0) = 0 then 0.1::double else max(m) filter (where o = 4) end) / greatest(1, coalesce(max(total) filter (where o = 4), 0)))) / 4) end as bleu
 from words join refs on refs.g = words.g and refs.l = len(words.w) left join clipped on clipped.g = words.g and clipped.k = words.k group by 1, 2),
bleu as (select g, count(*) as n, case when count(*) >= 2 then avg(bleu) end as self_bleu from scores group by 1)"""


CONFUSION = f"""p as ({fx.JUDGED_SQL}), l as (select unnest({fx.CLASSES}) as x),
c as (select a.x as actual, b.x as predicted, count(p.vec_id) as n from l a cross join l b left join p on p.actual = a.x and p.predicted = b.x group by all)"""

LOSSES = f"""with u as (select doc_id, {U.format(seed=42, key="doc_id")} as u, {TOKENS} as ws from documents),
t as (select doc_id, u, ws, unnest(range(1, len(ws) + 1)) as i from u), g as (select doc_id, u, i, case when i = 1 then '' else ws[i - 1] end as l, ws[i] as w, case when i = len(ws) then '' else ws[i + 1] end as r from t),
n3 as (select l, w, r, count(*) as n from g where u >= 0.2 group by all), x3 as (select l, r, sum(n) as n, count(*) as t from n3 group by all),
nl as (select l, w, sum(n) as n from n3 group by all), xl as (select l, sum(n) as n, count(*) as t from nl group by all), nr as (select r, w, sum(n) as n from n3 group by all), xr as (select r, sum(n) as n, count(*) as t from nr group by all),
n0 as (select w, sum(n) as n from n3 group by all), x0 as (select coalesce(sum(n), 0) as n, count(*) as t from n0),
a as (select doc_id, l, w, r from g where u < 0.2),
q as (select doc_id, (coalesce(n0.n, 0) + 1.0::double) / (x0.n + x0.t + 1) as p0, nl.n as cl, xl.n as al, xl.t as tl, nr.n as cr, xr.n as ar, xr.t as tr, n3.n as c3, x3.n as a3, x3.t as t3
  from a cross join x0 left join n0 on n0.w = a.w left join nl on nl.l = a.l and nl.w = a.w left join xl on xl.l = a.l left join nr on nr.r = a.r and nr.w = a.w left join xr on xr.r = a.r
  left join n3 on n3.l = a.l and n3.w = a.w and n3.r = a.r left join x3 on x3.l = a.l and x3.r = a.r),
p1 as (select *, ((case when al > 0 then (coalesce(cl, 0) + tl * p0) / (al + tl) else p0 end) + (case when ar > 0 then (coalesce(cr, 0) + tr * p0) / (ar + tr) else p0 end)) / 2 as p1 from q),
losses as (select doc_id, -avg(ln(case when a3 > 0 then (coalesce(c3, 0) + t3 * p1) / (a3 + t3) else p1 end)) as loss, count(*) as n_tokens from p1 group by 1)"""

SQL = {
    "clean_text": f"select doc_id, clean_text from ({CLEAN_DOCS})",
    "html_flatten": "select page_id, clean_text from (" + _clean("html", "page_id", "page_id", "pages") + ")",
    "corpus_stats": f"select source, count(*) as n_docs, round(avg(len({_words(chr(99) + 'oalesce(text, chr(32))')})), 6) as mean_words, round(avg(length(text)), 6) as mean_chars, sum(length(text))::bigint as sum_chars from documents group by source",
    "length_filter": f"select source, count(*) as n_docs, round(avg(n), 6) as mean_words from (select source, len({_words('clean_text')}) as n from ({CLEAN_DOCS}) where clean_text <> 'empty') where n >= 20 group by source",
    "relevance_score": f"""select doc_id, score from (select doc_id, len({_words('clean_text')}) as n, len(list_intersect(list_distinct(regexp_extract_all(lower(clean_text), '{tx.WORD}+')), {fx.VOCABULARY}))::int as score
      from ({CLEAN_DOCS}) where clean_text <> 'empty') where n >= 20 and score >= 2""",
    "keyword_relevance": f"""select page_id, len(list_intersect(list_distinct(regexp_extract_all(lower(clean_text), '{tx.WORD}+')), {vocabulary.lemma_set(vocabulary.CORRECTED)}))::int as score from ({_clean("html", "page_id", "page_id", "pages")}) where clean_text <> 'empty' and len({_words('clean_text')}) >= 20""",
    "relevance_lemmas": f"""select doc_id, count(distinct lemma)::int as score from (select doc_id, coalesce(lemma, word) as lemma from
      (select doc_id, unnest(regexp_extract_all(lower(clean_text), '{tx.WORD}+')) as word from ({CLEAN_DOCS}) where clean_text <> 'empty' and len({_words('clean_text')}) >= 20)
      left join (values {", ".join(map(str, fx.LEMMAS.items()))}) t(word, lemma) using (word)) where list_contains({fx.LEMMA_VOCABULARY}, lemma) group by 1 having count(distinct lemma) >= 2""",
    "emoji_names": f"select conv_id, turn, {list(fx.EMOJI.values())}[turn % 3 + 1] || coalesce(text, '') || {list(fx.EMOJI.values())}[conv_id % 3 + 1] as text from conversations",
    "truncated_words": f"select doc_id, array_to_string(list_slice({_words(chr(99) + 'oalesce(text, chr(32))')}, 1, 128), ' ') as text from documents",
    "text_hash": f"select {HASH} as hash, min(doc_id) as first_id, count(*) as n from documents group by 1",
    "exact_leak_url": "select page_id from pages where coalesce(url, '') not in (select url from pages where contains(url, '/de/'))",
    "exact_leak_text": f"select doc_id from documents where source <> 'src0' and {HASH} not in (select {HASH} from documents where source = 'src0')",
    "fuzzy_leak": "with t as (select (0, doc_id) as distinct_on, text from documents union all select (1, item_id), text from benchmark), grams as " + _grams("t") + """,
      idf as (select gram, ln((1 + (select count(*) from t)) / (1 + count(*))::double) + 1 as idf from grams group by 1),
      raw as (select distinct_on as id, gram, tf * idf as w from grams join idf using (gram)), norm as (select id, sqrt(sum(w * w)) as n from raw group by 1),
      vec as (select id, gram, w / n as w from raw join norm using (id)),
      dot as (select a.id[2] as doc_id, b.id as item, sum(a.w * b.w) as c from vec a join vec b using (gram) where a.id[1] = 0 and b.id[1] = 1 group by all),
      best as (select doc_id, max(c) as c from dot group by 1)
      select doc_id, round(coalesce(c, 0), 6) as max_cosine, round(coalesce(c, 0), 6) >= 0.9 as leaks from documents left join best using (doc_id)""",
    "minhash_bands": f"with {BANDS} select doc_id, band, bucket from bands",
    "near_dup_first_match": f"with {BANDS} select a.doc_id, min(b.doc_id) as first from bands a join bands b using (band, bucket) where b.doc_id < a.doc_id group by 1",
    "near_dup_verified": f"""with {BANDS}, m as (select a.doc_id, min(b.doc_id) as first from bands a join bands b using (band, bucket) where b.doc_id < a.doc_id group by 1),
      w as (select doc_id, list_distinct({TOKENS}) as w from documents), j as (select m.doc_id, first, len(list_intersect(x.w, y.w)) as c, len(x.w) + len(y.w) as n from m join w x on x.doc_id = m.doc_id join w y on y.doc_id = first)
      select doc_id, first, round(c / (n - c)::double, 6) as jaccard, round(c / (n - c)::double, 6) >= 0.85 as near from j""",
    "corpus_overview": f"select count(*) as n_docs, count(distinct source) as n_channels, round(avg(len({_words(chr(99) + 'oalesce(text, chr(32))')})), 6) as mean_words from documents",
    "newest_posts": "select event_type, event_id from events qualify row_number() over (partition by event_type order by ts desc nulls last, event_id desc) <= 200",
    "decontaminate": f"""with gold as (select doc_id, text || ' the end' as text from documents where source = 'src0'), docs as (select * from documents where {HASH} not in (select {HASH} from gold)),
      t as (select (0, doc_id) as distinct_on, text from docs union all select (1, doc_id), text from gold), grams as """ + _grams("t") + """,
      idf as (select gram, ln((1 + (select count(*) from t)) / (1 + count(*))::double) + 1 as idf from grams group by 1),
      raw as (select distinct_on as id, gram, tf * idf as w from grams join idf using (gram)), norm as (select id, sqrt(sum(w * w)) as n from raw group by 1),
      vec as (select id, gram, w / n as w from raw join norm using (id)),
      dot as (select a.id[1] as side, a.id[2] as doc_id, b.id as item, sum(a.w * b.w) as c from vec a join vec b using (gram) where a.id[1] = 0 and b.id[1] = 1 group by all)
      select doc_id from docs where doc_id not in (select doc_id from dot where round(c, 9) >= 0.9)""",
    "top_bigrams": _bigrams(""),
    "bigram_compare": f"select a.rank, a.term as left_term, a.n as left_n, b.term as right_term, b.n as right_n from ({_bigrams(chr(119) + 'here lang = ' + repr('en'))}) a join ({_bigrams(chr(119) + 'here lang = ' + repr('fr'))}) b using (rank)",
    "tfidf_terms": f"""with c as (select doc_id, term, count(*) as tf from (select doc_id, unnest({LONG_TOKENS}) as term from documents) group by all), n as (select count(*) as n from documents),
      idf as (select term, ln((1 + any_value(n)) / (1 + count(*))::double) + 1 as idf from c, n group by 1 having count(*) >= 3 and count(*) <= 0.8::double * any_value(n)),
      raw as (select doc_id, term, (1 + ln(tf)) * idf as w from c join idf using (term)), norm as (select doc_id, sqrt(sum(w * w)) as l from raw group by 1)
      select doc_id, term, round(w / l, 6) as w from raw join norm using (doc_id)""",
    "char_gram_df": "with t as (select doc_id as distinct_on, text from documents) select gram, count(*) as df from " + _grams("t") + " group by 1",
    "label_balance": f"with p as ({fx.CLASSES_SQL}) select actual, count(*) as n, round((select count(*) from p) / ((select count(distinct actual) from p) * count(*))::double, 6) as weight from p group by 1",
    "label_encode": f"with p as ({fx.CLASSES_SQL}) select doc_id, case actual when 'junk' then 0 when 'single' then 1 else 2 end as code from p",
    "confusion": f"with {CONFUSION} select actual, predicted, n from c",
    "class_report": f"""with {CONFUSION}, s as (select x as label, (select sum(n) from c where actual = x) as support, (select sum(n) from c where predicted = x) as claimed, (select sum(n) from c where actual = x and predicted = x) as hit from l),
      e as (select *, case when claimed = 0 then 0 else hit / claimed::double end as precision, case when support = 0 then 0 else hit / support::double end as recall from s),
      f as (select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1 from e),
      r as (select label, precision, recall, f1, support from f union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from f
        union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from f
        union all select 'accuracy', sum(hit) / sum(support)::double, sum(hit) / sum(support)::double, sum(hit) / sum(support)::double, sum(support) from f)
      select label, round(precision::double, 6) as precision, round(recall::double, 6) as recall, round(f1::double, 6) as f1, support::bigint as support from r""",
    "pairwise_cosine": """with u as (select label, list_transform(embedding, lambda v: v::double) as e from embeddings), n as (select label, list_transform(e, lambda v: v / sqrt(list_dot_product(e, e))) as e from u),
      s as (select label, i, sum(e[i]) as s, sum(e[i] * e[i]) as q from (select label, e, unnest(range(1, len(e) + 1)) as i from n) group by all), c as (select label, count(*) as n from embeddings group by 1)
      select label, any_value(n) as n, round((sum(s * s) - sum(q)) / (any_value(n) * (any_value(n) - 1)), 6) as mean_cosine from s join c using (label) group by 1""",
    "centroid_cosine": """with x as (select vec_id, label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as v from embeddings), c as (select label, i, avg(v) as c from x group by all),
      e as (select vec_id, label, sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))) as cosine from x join c using (label, i) group by all) select label, round(avg(cosine), 6) as mean_cosine from e group by 1""",
    "self_bleu": "with t as (select conv_id || '-' || turn as id, role, text from conversations), " + _self_bleu("t", "role", "id") + " select g as role, n, round(self_bleu, 6) as self_bleu from bleu",
    "model_benchmark": f"""with g as ({fx.GENERATED_SQL}), f as (select *, case when has_tokens then prompt_tokens end as pt, case when has_tokens then coalesce(completion_tokens, 0) end as ct from g),
      c as (select f.*, case when latency_sec is not null then ct / greatest(latency_sec, 0.001::double) end as tps, case when price_in is null then 0 else pt / 1e6 * price_in + ct / 1e6 * price_out end as cost from f left join {PRICES} using (model))
      select model, count(label) as records_count, round(avg(temperature), 6) as avg_temperature, round(avg(latency_sec), 6) as avg_latency_sec, round(avg(text_length_chars), 6) as avg_text_length, round(avg(tps), 6) as avg_tps, round(coalesce(sum(cost), 0), 6) as total_cost_usd
      from c where model is not null group by 1""",
    "generator_report": f"with g as ({fx.GENERATED_SQL}), t as (select record_id, model, label || ' ' || model || ' ' || (record_id % 5) as text from g where text is not null), " + _self_bleu("t", "model", "record_id") + " select g as model, n, round(1 - self_bleu, 6) as diversity_score from bleu",
    "quota": f"with g as ({fx.GENERATED_SQL}), q as (select * from (values ('junk', 2333), ('single', 2333), ('listing', 2334)) t(label, quota)) select label, count(g.record_id) as have, greatest(0, any_value(quota) - count(g.record_id))::bigint as remaining from q left join (select * from g where text is not null) g using (label) group by 1",
    "json_flatten": "select conv_id, turn, case when turn % 3 = 0 then role || text else text end as text from conversations",
    "message_links": "select conv_id, turn, case when conv_id % 2 = 0 then 'https://t.me/channel/' || turn else 'https://t.me/c/' || replace('-100' || conv_id, '-100', '') || '/' || turn end as url from conversations",
    "curve_pad": f"select condition, seed, e::int as epoch, curve[least(e, len(curve))] as value from ({fx.RUNS_SQL}), range(1, 11) t(e)",
    "early_stop": f"""with recursive r as ({fx.RUNS_SQL}), s as (select condition, seed, curve, 0 as epoch, '-infinity'::double as best, 0 as best_epoch, 0 as idle from r
      union all select condition, seed, curve, epoch + 1, greatest(best, curve[epoch + 1]), case when curve[epoch + 1] > best then epoch + 1 else best_epoch end, case when curve[epoch + 1] > best then 0 else idle + 1 end from s where epoch < len(curve) and idle < 2)
      select condition, seed, max_by(best, epoch) as best, max_by(best_epoch, epoch) as best_epoch, max(epoch) as stopped_at from s group by 1, 2""",
    "epoch_stats": f"select condition, e::int as epoch, round(avg(curve[least(e, len(curve))]), 6) as mean, round(stddev_pop(curve[least(e, len(curve))]), 6) as std from ({fx.RUNS_SQL}), range(1, 11) t(e) group by 1, 2",
    "confidence_interval": f"with m as ({fx.METRICS_SQL}) select condition, metric, count(*) as n, round(avg(value), 6) as mean, round({T975}::double * stddev_samp(value) / sqrt(count(*)), 6) as margin from m group by all",
    "ci_delta": f"with {DELTAS} select condition, metric, round(avg(d), 6) as mean, round({T975}::double * stddev_samp(d) / sqrt(count(*)), 6) as margin, avg(d) - {T975}::double * stddev_samp(d) / sqrt(count(*)) > 0 as positive from delta group by all",
    "paired_ttest": f"with {DELTAS} select condition, metric, round(mean_difference, 6) as mean_difference, round(t, 6) as t, round({_p('t')}, 6) as p from ({TEST.format(rows='delta')})",
    "one_sample_ttest": f"with m as ({fx.METRICS_SQL}), delta as (select condition, metric, value - {CONSTANT} as d from m) select condition, metric, round(mean_difference, 6) as mean_difference, round(t, 6) as t, round({_p('t')}, 6) as p from ({TEST.format(rows='delta')})",
    "holm": f"""with {DELTAS}, one as (select condition, metric, value - {CONSTANT} as d from m), tests as (select 'paired' as test, * from ({TEST.format(rows='delta')}) union all select 'one-sample', * from ({TEST.format(rows='one')})),
      p as (select test, condition, metric, round({_p('t')}, 9) as p from tests), r as (select *, (count(*) over (partition by metric) - row_number() over (partition by metric order by p) + 1) * p as s from p),
      h as (select *, least(1, max(s) over (partition by metric order by p range unbounded preceding)) as h from r) select test, condition, metric, round(p, 6) as p, round(h, 6) as p_holm, h <= 0.05::double as significant from h""",
    "cartography": """with h as (select (case when label < 4 then 'golden_' when label < 8 then 'aug_' else 'other_' end) || vec_id as id, label, list_transform(embedding[1:5], lambda v: round(v::double, 4)) as h from embeddings),
      x as (select id, label, unnest(h) as v from h) select id, case when any_value(label) < 4 then 'Organic' when any_value(label) < 8 then 'Synthetic' end as origin, round(avg(v), 6) as confidence, round(stddev_pop(v), 6) as variability from x group by 1""",
    "strat_split": f"""with p as ({fx.CLASSES_SQL}), r as (select *, row_number() over (partition by actual order by md5('42:' || doc_id), doc_id) as r, count(*) over (partition by actual) as n from p)
      select doc_id, actual, case when r <= floor(0.2::double * n + 0.5) then 'test' else 'train' end as part from r""",
    "hash_sample": "select doc_id, source from documents order by md5('7:' || doc_id), doc_id limit 300",
    "weighted_choice": f"select doc_id, {_weighted()} as model, round(0.3::double + 0.9::double * {U.format(seed=6, key='doc_id')}, 2) as temperature from documents",
    "prompt_gen": f"select record_id, case label when 'single' then {_prompt('single', 42)} when 'listing' then {_prompt('listing', 42)} when 'junk' then {_prompt('junk', 42)} end as prompt from ({fx.GENERATED_SQL})",
    "prompt_grammar": f"select event_id, {_grammar(prompts.ANNOUNCEMENT.template, prompts.ANNOUNCEMENT.fields, 11, 'event_id')} as prompt from events",
    "suffix_lemmas": f"""with v as (select distinct word from (select unnest({TOKENS}) as word from documents) where length(word) >= 5),
      k as (select a.word, max(b.word) as lemma from (select word, left(word, length(word) - unnest([1, 2, 3])) as part from v) a join v b on b.word = a.part group by 1),
      p as (select *, length(word) - length(lemma) as cut, ('0x' || substr(md5(word), 1, 8))::bigint % 5 as part from k),
      e as (select right(word, i) as ending, cut, count(*) as n from (select word, cut, unnest(range(cut, least(5, length(word) - 1) + 1)) as i from p where part > 0) group by all having count(*) >= 2),
      r as (select ending, arg_min(cut, (-n, cut)) as cut from e group by 1)
      select word, coalesce(left(word, length(word) - arg_max(cut, length(ending))), word) as lemma from (select p.word, r.ending, r.cut from (select word, unnest(range(0, least(5, length(word) - 1) + 1)) as i from p where part = 0) p left join r on r.ending = right(p.word, i)) group by word""",
    "best_run": f"with m as ({fx.METRICS_SQL}) select condition, metric, arg_max(seed, (value, -seed)) as seed, max(value) as value from m group by all",
    "axis_bound": f"""with {DELTAS}, b as (select avg(d) as mean, {T975}::double * stddev_samp(d) / sqrt(count(*)) as margin from delta group by condition, metric)
      select round(1.4::double * max(greatest(abs(mean + margin), abs(mean - margin), 0.0581::double)), 6) as bound from b""",
    "macro_centroid_cosine": """with x as (select vec_id, label, unnest(range(1, len(embedding) + 1)) as i, unnest(embedding)::double as v from embeddings), c as (select label, i, avg(v) as c from x group by all),
      e as (select vec_id, label, sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))) as cosine from x join c using (label, i) group by all), l as (select avg(cosine) as m from e group by label) select round(avg(m), 6) as macro_mean_cosine from l""",
    "token_losses": LOSSES + " select doc_id, round(loss, 6) as loss, n_tokens from losses",
    "pseudo_perplexity": LOSSES + " select source, round(exp(sum(loss * n_tokens) / sum(n_tokens)), 4) as pppl from losses join documents using (doc_id) group by 1",
    "softmax_predict": """with l as (select vec_id, list_transform(embedding[1:3], lambda x: round(x::double, 4)) as z from embeddings), e as (select vec_id, z, list_transform(z, lambda x: exp(x - list_max(z))) as e from l)
      select vec_id, ['junk', 'single', 'listing'][list_position(z, list_max(z))] as label, round(list_max(e) / list_sum(e), 6) as p, round(-[1.0::double, 2.0::double, 0.5::double][(vec_id % 3 + 1)::int] * ln(e[(vec_id % 3 + 1)::int] / list_sum(e)), 6) as loss from e""",
    "warmup_schedule": """with s as (select distinct vec_id // 8 as step from embeddings), t as (select max(step) + 1 as total, greatest(1, floor((max(step) + 1) * 0.1::double))::bigint as up from s)
      select step, round((case when step < up then 2e-5::double * step / up else 2e-5::double * greatest(0.0::double, (total - step)::double / greatest(1, total - up)) end) * 1e6, 6) as rate from s, t""",
    "experiment_sizes": "select (select count(*) from documents) as train_size, (select count(*) from benchmark) as test_size, count(*) as aug_size, true as tapt_enabled, count(*) > 0 as aug_enabled from documents where lang = 'es'",
    "crawl_targets": "select split_part(url, '/', -1) as name, arg_min(url, page_id) as entity from pages where url is not null group by 1",
    "fill_quotas": f"""with g as (select record_id, label from ({fx.GENERATED_SQL}) where text is not null), q as (select * from (values ('junk', 2000), ('single', 1700), ('listing', 10)) t(label, quota)),
      have as (select q.label, greatest(0, any_value(quota) - count(g.record_id)) as open from q left join (select * from g where record_id % 2 = 0) g using (label) group by 1),
      r as (select *, row_number() over (partition by label order by record_id) as r from g where record_id % 2 <> 0) select record_id, label from r join have using (label) where r <= open""",
}
SQL["map_anchors"] = f"with c as ({SQL['cartography']}) select round(min(variability), 6) as easy_x, round(0.75::double * max(variability), 6) as hard_x from c"
