"""DuckDB statements that give what the registered queries give."""

from __future__ import annotations

from lexispark.functions.text import WHITE_SPACE
from lexispark.operators.features import CORPUS_KEYS

# Fixed value: the English stop words, as functions.text.stop_words gives them.
STOP = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can "
    "can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have "
    "haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it "
    "it's its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own "
    "same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then there "
    "there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're we've "
    "were weren't what what's when when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll "
    "you're you've your yours yourself yourselves"
).split()


def _stop_list() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in STOP)


def _base(corpus: str | None = None) -> str:
    """Tokens, postings, terms and statistics, of one corpus or of one for each value of a column."""
    c = f"{corpus} as corpus_id" if corpus else "0 as corpus_id"
    position = f"row_number() over (partition by {corpus} order by cast(doc_id as varchar)) - 1" if corpus else "doc_id"
    return f"""
with tok as (select {c}, {position} as doc_idx, list_filter(string_split_regex(lower(text), '{WHITE_SPACE}'), lambda x: x <> '') as tokens from documents),
docs as (select corpus_id, doc_idx, len(tokens) as dl from tok),
post as (select corpus_id, doc_idx, len(tokens)::int as dl, term, count(*) as tf from (select corpus_id, doc_idx, tokens, unnest(tokens) as term from tok) group by all),
terms as (select corpus_id, term, count(*) as df, sum(tf)::bigint as cf, min(doc_idx) as first_doc from post group by all),
corpus as (select corpus_id, count(*) as n, coalesce(sum(dl), 0)::bigint as total, coalesce(avg(dl), 0) as avgdl from docs group by all),
per as (select corpus_id, doc_idx, count(*) as uniq, max(tf) filter (term not in ({_stop_list()})) as max_tf, coalesce(sum(tf) filter (term in ({_stop_list()})), 0) as stop_tokens from post group by all),
dstat as (
  select d.corpus_id, d.doc_idx, d.dl, coalesce(uniq, 0)::bigint as uniq, coalesce(max_tf, 0)::bigint as max_tf, coalesce(stop_tokens, 0)::bigint as stop_tokens,
    coalesce(uniq / nullif(d.dl, 0)::double, 0) as ttr, coalesce(d.dl / nullif(uniq, 0)::double, 0) as mean_tf
  from docs d left join per using (corpus_id, doc_idx)
),
qtok as (select item_id as q_idx, list_filter(string_split_regex(lower(text), '{WHITE_SPACE}'), lambda x: x <> '') as tokens from benchmark),
qt as (select q_idx, term, count(*) as qtf from (select q_idx, unnest(tokens) as term from qtok) group by all),
rel as (
  select item_id as q_idx, item_id::varchar as qid, d.doc_id, d.doc_id::varchar as doc, (1 + coalesce(quality, 0))::int as relevance
  from documents d join benchmark b on contains(d.text, b.text) left join labels l on l.doc_id = d.doc_id
),
lenf as (
  select corpus_id, count(*) as doc_count, count(*) as num_docs, sum(dl)::bigint as total_tokens, avg(dl) as avgdl, coalesce(stddev_samp(dl), 0) as std_len,
    coalesce(stddev_samp(dl) / nullif(avg(dl), 0), 0) as cv_len,
    case when count(*) > 2 and stddev_pop(dl) > 0 then skewness(dl) else 0 end as len_skew,
    quantile_cont(dl::double, 0.9) as len_p90, quantile_cont(dl::double, 0.1) as len_p10,
    quantile_cont(dl::double, 0.9) / greatest(quantile_cont(dl::double, 0.1), 1) as len_ratio_p90_p10
  from docs group by all
),
freqf as (
  select corpus_id, avg(ttr) as avg_ttr, avg(max_tf) as avg_max_tf,
    case when count(*) > 2 and stddev_pop(dl) > 0 and stddev_pop(mean_tf) > 0 then corr(dl, mean_tf) else 0 end as length_tf_corr,
    coalesce(sum(stop_tokens) / nullif(sum(dl), 0)::double, 0) as stopword_density
  from dstat group by all
),
vocf as (select corpus_id, avg((cf = 1)::int) as hapax_ratio, count(*) as vocab_size from terms group by all),
ranked as (select corpus_id, ln(cf) as y, ln(row_number() over (partition by corpus_id order by cf desc, term)) as x from terms),
zipff as (select corpus_id, case when count(distinct x) > 1 then abs(regr_slope(y, x)) else 0 end as zipf_alpha from ranked group by all),
places as (
  select distinct corpus_id, greatest(0, least(n - 1, round_even(pow(10, i * log10(n) / 49), 0)::bigint - 1)) as p
  from corpus, range(0, 50) t(i) where n > 50
  union all
  select corpus_id, unnest(range(0, n)) from corpus where n <= 50
),
growth as (
  select p.corpus_id, p.p, (select sum(dl) from docs d where d.corpus_id = p.corpus_id and d.doc_idx <= p.p) as n,
    (select count(*) from terms t where t.corpus_id = p.corpus_id and t.first_doc <= p.p) as v
  from places p
),
heapsf as (select corpus_id, case when count(distinct n) > 1 then regr_slope(ln(v), ln(n)) else 0 end as heaps_beta from growth where n > 0 group by all),
feat as (
  select corpus_id, doc_count, num_docs, total_tokens, avgdl, std_len, cv_len, len_skew, len_p90, len_p10, len_ratio_p90_p10, avg_ttr, avg_max_tf, length_tf_corr,
    hapax_ratio, vocab_size, zipf_alpha, heaps_beta, stopword_density
  from lenf join freqf using (corpus_id) join vocf using (corpus_id) join zipff using (corpus_id) join heapsf using (corpus_id)
)"""


_QUERY_SIDE = """,
qper as (select q_idx, sum(qtf) as n, max(qtf) as m from qt group by all),
quse as (select qt.qtf, t.df, case when t.df is not null then ln((c.n - t.df + 0.5) / (t.df + 0.5)) end as w from qt cross join corpus c left join terms t on t.term = qt.term),
qval as (select w from quse, range(0, qtf) where w is not null),
qf as (
  select (select avg(n) from qper) as avg_query_len, (select avg(m) from qper) as avg_query_max_tf, (select avg((m > 1)::int) from qper) as query_repeat_ratio,
    (select sum(case when df is null then qtf else 0 end) / sum(qtf)::double from quse) as query_oov_ratio,
    (select avg(w) from qval) as query_idf_mean, (select coalesce(stddev_samp(w), 0) from qval) as query_idf_std
)"""

_HEURISTIC = """
  round(greatest(0.5, least(3, 1.5 - 1.5 * avg_ttr + 0.3 * least(avg_max_tf / 20, 1))), 4)::double as k1,
  round(greatest(0, least(1, 0.5 + 0.4 * length_tf_corr - 0.3 * cv_len)), 4)::double as b,
  round(greatest(0, least(8, {k3})), 4)::double as k3,
  round(greatest(0, least(2, cv_len)), 4)::double as delta,
  case when heaps_beta > 0.7 or hapax_ratio > 0.6 then 'smoothed' else 'rsj' end as idf_type"""
_K3 = "0.5 * greatest(avg_query_max_tf - 1, 0) + 2 * query_repeat_ratio"
_VARIANT = "case when delta > 0 then 'bm25+' else 'bm25' end as model_variant"


def _scored(params: str) -> str:
    """Scores with the columns of ``params`` (k1, b, k3, delta, idf_type), ranked."""
    return f""",
par as ({params}),
weighed as (
  select qt.q_idx, p.doc_idx, p.tf, p.dl, qt.qtf, c.avgdl, par.*, case when par.idf_type = 'rsj' then ln((c.n - t.df + 0.5) / (t.df + 0.5)) else ln((c.n + 1.0) / (t.df + 1.0)) end as w
  from qt join post p on p.term = qt.term join terms t on t.term = qt.term cross join corpus c cross join par
),
scored as (
  select q_idx, doc_idx, sum(w * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))) * (case when k3 > 0 and qtf > 1 then qtf * (k3 + 1) / (qtf + k3) else 1 end) + w * delta) as score
  from weighed group by all having score <> 0
),
hits as (select q_idx, doc_idx, score, (row_number() over (partition by q_idx order by round(score, 9) desc, doc_idx))::int as rank from scored)"""


def _fixed(k1=1.2, b=0.75, k3=0.0, delta=0.0, kind="rsj") -> str:
    return f"select {k1}::double as k1, {b}::double as b, {k3}::double as k3, {delta}::double as delta, '{kind}' as idf_type"


_ADAPTIVE = f"select {_HEURISTIC.format(k3=_K3)} from feat, qf"

_METRICS = """,
ideal as (
  select q_idx, qid, sum(case when r <= 10 then relevance / log2(r + 1) else 0 end) as idcg, count(*) as n_rel
  from (select *, row_number() over (partition by qid order by relevance desc, doc) as r from rel) group by all
),
judged as (
  select i.q_idx, coalesce(1.0 / min(case when rank <= 10 and relevance is not null then rank end), 0)::double as mrr,
    coalesce(sum(case when rank <= 10 then relevance / log2(rank + 1) else 0 end) / any_value(idcg), 0)::double as ndcg,
    (count(*) filter (rank <= 100 and relevance is not null) / any_value(n_rel))::double as recall
  from ideal i left join (select h.q_idx, h.rank, r.relevance from hits h join rel r on r.q_idx = h.q_idx and r.doc_id = h.doc_idx where h.rank <= 100) h using (q_idx) group by i.q_idx
),
means as (select avg(mrr) as "mrr@10", avg(ndcg) as "ndcg@10", avg(recall) as "recall@100", count(*) as num_queries from judged)"""


def _round(columns, digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) as "{c}"' for c in columns)


_DOUBLES = [k for k in CORPUS_KEYS if k != "vocab_size"]
_QUERY = ["avg_query_len", "avg_query_max_tf", "query_repeat_ratio", "query_oov_ratio", "query_idf_mean", "query_idf_std"]


def _dictionary() -> str:
    """Entries by source and targets by language, in long form, with the normaliser and distances."""
    parts = []
    for prefix, column in (("s", "source"), ("l", "lang")):
        body = _base(column).strip().removeprefix("with ")
        for name in ("tok", "docs", "post", "terms", "corpus", "per", "dstat", "qtok", "qt", "rel", "lenf", "freqf", "vocf", "ranked", "zipff", "places", "growth", "heapsf", "feat"):
            body = _rename(body, name, f"{prefix}_{name}")
        parts.append(body)
    values = ", ".join(f"{{'key': '{k}', 'value': round({k}::double, 9)}}" for k in CORPUS_KEYS)
    return "with " + ",\n".join(parts) + f""",
entry as (select corpus_id as name, u.key, u.value from (select corpus_id, unnest([{values}]) as u from s_feat)),
params as (select corpus_id as name, {_HEURISTIC.format(k3='0')} from s_feat),
target as (select corpus_id, u.key, u.value from (select corpus_id, unnest([{values}]) as u from l_feat)),
norm as (select key, avg(value) as mean, case when stddev_pop(value) > 0 then stddev_pop(value) else 1 end as std, min(value) as low, max(value) as high from entry group by key),
ze as (select e.name, key, (e.value - mean) / std as z from entry e join norm using (key)),
zt as (select t.corpus_id, key, (t.value - mean) / std as z from target t join norm using (key)),
dist as (select zt.corpus_id, ze.name, sqrt(avg(pow(zt.z - ze.z, 2))) as distance from zt join ze using (key) group by all),
ood as (
  select corpus_id, sum((value < low - 0.5 * span or value > high + 0.5 * span)::int)::bigint as outside
  from (select t.corpus_id, t.value, low, high, case when high > low then high - low else 1 end as span from target t join norm using (key)) group by all
),
near as (select *, row_number() over (partition by corpus_id order by distance, name) as r from dist join params using (name))"""


def _rename(body: str, name: str, new: str) -> str:
    import re

    return re.sub(rf"(?<![\w.'\"]){name}(?=\s+as \(|\s|,|\)|$)(?!\s*\()", new, body)


def _lookup(k: int) -> str:
    return f"""select corpus_id, {_round(['k1', 'b', 'k3', 'delta'])}, idf_type, {_VARIANT}, dict_match from (
  select corpus_id, avg(k1) as k1, avg(b) as b, avg(k3) as k3, avg(delta) as delta,
    case when count(*) filter (idf_type = 'rsj') * 2 > count(*) or (count(*) filter (idf_type = 'rsj') * 2 = count(*) and arg_min(idf_type, r) = 'rsj') then 'rsj' else 'smoothed' end as idf_type,
    arg_min(name, r) as dict_match
  from near where r <= {k} group by corpus_id)"""


def _grid(k1, b, k3, delta, kinds) -> str:
    values = lambda name, xs: f"(select unnest([{', '.join(repr(x) for x in xs)}]{'::double[]' if name != 'idf_type' else ''}) as {name})"
    sizes = (len(b) * len(k3) * len(delta) * len(kinds), len(k3) * len(delta) * len(kinds), len(delta) * len(kinds), len(kinds))
    at = lambda name, xs: f"list_position([{', '.join(repr(x) for x in xs)}]{'::double[]' if name != 'idf_type' else ''}, {name}) - 1"
    ident = f"(({at('k1', k1)}) * {sizes[0]} + ({at('b', b)}) * {sizes[1]} + ({at('k3', k3)}) * {sizes[2]} + ({at('delta', delta)}) * {sizes[3]} + {at('idf_type', kinds)})::int"
    return f"select {ident} as combo_id, * from {values('k1', k1)}, {values('b', b)}, {values('k3', k3)}, {values('delta', delta)}, {values('idf_type', kinds)}"


def _whole_grid(base: str, s) -> str:
    """Every combination: sums by base and query frequency, then the rank of each relevant document by counting who is
    better, so that no list of all scores is sorted."""
    list_of = lambda xs: f"[{', '.join(repr(x) for x in xs)}]"
    return base + f""",
par as ({_grid(s.k1, s.b, s.k3, s.delta, s.idf_type)}),
matched as (
  select qt.q_idx, p.doc_idx, p.tf, p.dl / c.avgdl as r, qt.qtf, ln((c.n - t.df + 0.5) / (t.df + 0.5)) as w_rsj, ln((c.n + 1.0) / (t.df + 1.0)) as w_smoothed
  from qt join post p on p.term = qt.term join terms t on t.term = qt.term cross join corpus c where qt.q_idx in (select q_idx from rel)
),
based as (
  select q_idx, doc_idx, qtf, k1, b, sum(w_rsj * tf * (k1 + 1) / (tf + k1 * (1 - b + b * r))) as a_rsj, sum(w_smoothed * tf * (k1 + 1) / (tf + k1 * (1 - b + b * r))) as a_smoothed, sum(w_rsj) as i_rsj, sum(w_smoothed) as i_smoothed
  from matched cross join (select unnest({list_of(s.k1)}::double[]) as k1) cross join (select unnest({list_of(s.b)}::double[]) as b) group by all
),
summed as (
  select q_idx, doc_idx, k1, b, k3, sum(a_rsj * s) as a_rsj, sum(a_smoothed * s) as a_smoothed, sum(i_rsj) as i_rsj, sum(i_smoothed) as i_smoothed
  from (select based.*, k3, case when k3 > 0 and qtf > 1 then qtf * (k3 + 1) / (qtf + k3) else 1 end as s from based cross join (select unnest({list_of(s.k3)}::double[]) as k3)) group by all
),
wanted as (select s.*, relevance from summed s join rel r on r.q_idx = s.q_idx and r.doc_id = s.doc_idx),
compared as (
  select q_idx, doc_idx, relevance, k1, b, k3, idf_type, delta, other, round(own_a + delta * own_i, 9) as own, round(a + delta * i, 9) as score from (
    select w.q_idx, w.doc_idx, w.relevance, w.k1, w.b, w.k3, 'rsj' as idf_type, d.doc_idx as other, w.a_rsj as own_a, w.i_rsj as own_i, d.a_rsj as a, d.i_rsj as i
    from wanted w join summed d on d.q_idx = w.q_idx and d.k1 = w.k1 and d.b = w.b and d.k3 = w.k3
    union all
    select w.q_idx, w.doc_idx, w.relevance, w.k1, w.b, w.k3, 'smoothed', d.doc_idx, w.a_smoothed, w.i_smoothed, d.a_smoothed, d.i_smoothed
    from wanted w join summed d on d.q_idx = w.q_idx and d.k1 = w.k1 and d.b = w.b and d.k3 = w.k3
  ) cross join (select unnest({list_of(s.delta)}::double[]) as delta)
),
placed as (
  select q_idx, doc_idx, relevance, k1, b, k3, idf_type, delta, 1 + count(*) filter (score <> 0 and (score > own or (score = own and other < doc_idx))) as rank
  from compared where own <> 0 group by all
),
ideal as (
  select q_idx, sum(case when r <= 10 then relevance / log2(r + 1) else 0 end) as idcg, count(*) as n_rel
  from (select *, row_number() over (partition by qid order by relevance desc, doc) as r from rel) group by all
),
judged as (
  select combo_id, i.q_idx, coalesce(1.0 / min(case when rank <= 10 then rank end), 0) as mrr, sum(case when rank <= 10 then relevance / log2(rank + 1) else 0 end) / any_value(idcg) as ndcg,
    count(*) / any_value(n_rel) as recall
  from placed p join par using (k1, b, k3, delta, idf_type) join ideal i using (q_idx) where rank <= 100 group by all
),
results as (
  select combo_id, k1, b, k3, delta, idf_type, round(coalesce(sum(mrr), 0) / nq, 6) as "mrr@10", round(coalesce(sum(ndcg), 0) / nq, 6) as "ndcg@10", round(coalesce(sum(recall), 0) / nq, 6) as "recall@100", nq as num_queries
  from par left join judged using (combo_id) cross join (select count(*) as nq from ideal) group by combo_id, k1, b, k3, delta, idf_type, nq
)"""


def statements() -> dict[str, str]:
    from lexispark.operators.grid import Space
    from lexispark.plans.catalog import SMALL_SAMPLE, SPACE

    base, full = _base(), _base() + _QUERY_SIDE
    top = lambda params, k: base + _scored(params) + f" select q_idx, rank, doc_idx, round(score, 6) as score from hits where rank <= {k}"
    adaptive = full + _scored(_ADAPTIVE)
    named = ["mrr@10", "ndcg@10", "recall@100"]
    by = lambda c: _base(c) + f" select corpus_id, doc_count, num_docs, total_tokens, vocab_size, {_round(_DOUBLES)} from feat"
    words = _dictionary()
    sample = f""",
ids as (select distinct doc_id from rel),
good as (select doc_id as doc_idx, true as relevant from documents where doc_id in (select doc_id from ids) order by doc_id limit {SMALL_SAMPLE}),
rest as (
  select doc_id as doc_idx, false as relevant from documents where doc_id not in (select doc_id from ids)
  order by md5('42:' || doc_id), doc_id limit (select greatest(0, {SMALL_SAMPLE} - least({SMALL_SAMPLE}, count(*))) from ids)
),
sample as (select * from good union all select * from rest)"""
    combo = _grid(*(getattr(SPACE, n) for n in ("k1", "b", "k3", "delta", "idf_type")))
    grid = base + f""",
par as ({combo}),
weighed as (
  select par.*, qt.q_idx, p.doc_idx, p.tf, p.dl, qt.qtf, c.avgdl, case when par.idf_type = 'rsj' then ln((c.n - t.df + 0.5) / (t.df + 0.5)) else ln((c.n + 1.0) / (t.df + 1.0)) end as w
  from qt join post p on p.term = qt.term join terms t on t.term = qt.term cross join corpus c cross join par where qt.q_idx in (select q_idx from rel)
),
scored as (
  select combo_id, q_idx, doc_idx, sum(w * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))) * (case when k3 > 0 and qtf > 1 then qtf * (k3 + 1) / (qtf + k3) else 1 end) + w * delta) as score
  from weighed group by all having score <> 0
),
hits as (select combo_id, q_idx, doc_idx, row_number() over (partition by combo_id, q_idx order by round(score, 9) desc, doc_idx) as rank from scored),
ideal as (
  select q_idx, sum(case when r <= 10 then relevance / log2(r + 1) else 0 end) as idcg, count(*) as n_rel
  from (select *, row_number() over (partition by qid order by relevance desc, doc) as r from rel) group by all
),
judged as (
  select combo_id, i.q_idx, coalesce(1.0 / min(case when rank <= 10 then rank end), 0) as mrr, sum(case when rank <= 10 then relevance / log2(rank + 1) else 0 end) / any_value(idcg) as ndcg,
    count(*) / any_value(n_rel) as recall
  from ideal i join hits h using (q_idx) join rel r on r.q_idx = h.q_idx and r.doc_id = h.doc_idx where rank <= 100 group by all
),
results as (
  select combo_id, k1, b, k3, delta, idf_type, round(coalesce(sum(mrr), 0) / nq, 6) as "mrr@10", round(coalesce(sum(ndcg), 0) / nq, 6) as "ndcg@10", round(coalesce(sum(recall), 0) / nq, 6) as "recall@100", nq as num_queries
  from par left join judged using (combo_id) cross join (select count(*) as nq from ideal) group by combo_id, k1, b, k3, delta, idf_type, nq
)"""
    s = Space()
    whole = _whole_grid(base, s)
    return {
        "tokenize_documents": base + " select doc_idx as doc_id, array_to_string(tokens, ' ') as tokens from tok",
        "term_counts_first_pos": base + " select doc_idx, term, count(*) as n, min(pos)::int as first_pos from (select doc_idx, unnest(tokens) as term, unnest(range(0, len(tokens))) as pos from tok) group by all",
        "postings": base + " select doc_idx, dl, term, tf from post",
        "doc_stats": base + " select doc_idx, dl::int as dl, uniq, max_tf, stop_tokens, round(ttr, 6) as ttr, round(mean_tf, 6) as mean_tf from dstat",
        "term_stats": base + " select term, df, cf, first_doc from terms",
        "corpus_stats": base + " select n as doc_count, total as total_tokens, round(avgdl, 6) as avgdl from corpus",
        "feat_length_distribution": base + f" select doc_count, num_docs, total_tokens, {_round(['avgdl', 'std_len', 'cv_len', 'len_skew', 'len_p90', 'len_p10', 'len_ratio_p90_p10'])} from lenf",
        "feat_term_frequency": base + f" select {_round(['avg_ttr', 'avg_max_tf', 'length_tf_corr', 'stopword_density'])} from freqf",
        "feat_vocabulary": base + " select round(hapax_ratio, 6) as hapax_ratio, vocab_size from vocf",
        "feat_zipf": base + " select round(zipf_alpha, 6) as zipf_alpha from zipff",
        "feat_heaps": base + " select round(heaps_beta, 6) as heaps_beta from heapsf",
        "feat_query_side": full + f" select {_round(_QUERY)} from qf",
        "features_all": full + f" select doc_count, num_docs, total_tokens, vocab_size, {_round(_DOUBLES)}, {_round(_QUERY)} from feat, qf",
        "features_by_source": by("source"),
        "features_by_lang": by("lang"),
        "idf_rsj": base + " select term, round(ln((n - df + 0.5) / (df + 0.5)), 6) as idf from terms, corpus",
        "idf_smoothed": base + " select term, round(ln((n + 1.0) / (df + 1.0)), 6) as idf from terms, corpus",
        "bm25_default_top10": top(_fixed(), 10),
        "bm25_k3_top10": top(_fixed(k3=4.0), 10),
        "bm25_plus_top10": top(_fixed(delta=1.0), 10),
        "bm25_smoothed_top10": top(_fixed(kind="smoothed"), 10),
        "bm25_negative_scores": base + _scored(_fixed()) + " select q_idx, doc_idx, round(score, 6) + 0.0 as score from scored where score < 0",
        "bm25_single_query": base + _scored(_fixed()) + " select rank, doc_idx, round(score, 6) as score from hits where q_idx = 2 and rank <= 10",
        "score_doc_postings": base + " select doc_idx, tf, dl, round(w * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) + w * 0.5, 6) as score from (select p.*, avgdl, ln((n - df + 0.5) / (df + 0.5)) as w from post p join terms t on t.term = p.term cross join corpus where p.term = 'the')",
        "bm25_adaptive_top100": adaptive + " select q_idx, rank, doc_idx, round(score, 6) as score from hits where rank <= 100",
        "heuristic_params": full + f" select *, {_VARIANT} from ({_ADAPTIVE})",
        "heuristic_params_by_source": _base("source") + f" select *, {_VARIANT} from (select corpus_id, {_HEURISTIC.format(k3='0')} from feat)",
        "dict_normaliser": words + f" select key, {_round(['mean', 'std', 'low', 'high'])} from norm",
        "dict_zscores": words + " select corpus_id, key, round(z, 6) as z from zt",
        "dict_distances": words + " select corpus_id, name, round(distance, 6) as distance from dist",
        "dict_ood_flags": words + " select corpus_id, outside, outside >= 2 as oov from ood",
        "dict_lookup_k1": words + _lookup(1),
        "dict_lookup_k3": words + _lookup(3),
        "dict_probe": words + " select corpus_id, outside >= 2 as oov, round(distance, 6) as distance, name as nearest from ood join near using (corpus_id) where r = 1",
        "predict_with_dictionary": words + f""" select corpus_id, {_round(['k1', 'b', 'k3', 'delta'], 4)}, idf_type, {_VARIANT}, source from (
  select corpus_id, k1, b, k3, delta, idf_type, 'dictionary' as source from near join ood using (corpus_id) where r = 1 and distance <= 2 and outside < 2
  union all
  select corpus_id, {_HEURISTIC.format(k3='0')}, 'heuristic' from l_feat where corpus_id not in (select corpus_id from near join ood using (corpus_id) where r = 1 and distance <= 2 and outside < 2))""",
        "qrels_derived": base + " select qid, doc as doc_id, relevance from rel",
        "ideal_dcg": base + _scored(_fixed()) + _METRICS + " select qid, round(idcg, 6) as idcg, n_rel from ideal",
        "metrics_per_query": base + _scored(_fixed()) + _METRICS + f" select q_idx, {_round(['mrr', 'ndcg', 'recall'])} from judged",
        "metrics_default": base + _scored(_fixed()) + _METRICS + f" select {_round(named)}, num_queries from means",
        "metrics_adaptive": adaptive + _METRICS + f" select {_round(named)}, num_queries from means",
        "metrics_improvement": f"with d as ({base + _scored(_fixed()) + _METRICS} select * from means), a as ({adaptive + _METRICS} select * from means) select "
        + ", ".join(f'round(coalesce((a."{n}" - d."{n}") * 100 / nullif(d."{n}", 0), 0), 4) as "improve_vs_default_{n}"' for n in named) + " from d, a",
        "results_nested": base + _scored(_fixed()) + " select item_id::varchar as qid, count(rank) as n, coalesce(string_agg(rank || ':' || doc_idx, ',' order by rank), '') as results from benchmark left join (select * from hits where rank <= 10) h on h.q_idx = item_id group by item_id",
        "grid_combos": _grid(s.k1, s.b, s.k3, s.delta, s.idf_type),
        "grid_search": whole + " select * from results",
        "grid_search_best": whole + ' select * from results order by "ndcg@10" desc, combo_id limit 1',
        "grid_search_small": grid + " select * from results",
        "grid_best": grid + ' select * from results order by "ndcg@10" desc, combo_id limit 1',
        "stratified_subsample": base + sample + " select doc_idx, relevant from sample",
        "subsample_qrels": base + sample + " select qid, doc as doc_id, relevance from rel where doc_id in (select doc_idx from sample)",
        "snippets": f"select doc_id, array_to_string(list_filter(string_split_regex(text, '{WHITE_SPACE}'), lambda x: x <> ''), ' ')[:110] as snippet from documents",
    }
