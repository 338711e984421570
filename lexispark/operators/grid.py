"""Grid search over parameters, factorised.

A score is ``sum_c w(c, k3) A_c(k1, b, idf) + delta I(idf)`` over the classes c of query frequency. So postings are
aggregated for the (k1, b, idf) bases only, a row for each k1 and a column for each (b, idf), and k3 and delta come later.
Metrics ask where the relevant documents rank, so a document that scores below all of them does not matter. Bounds over
ranges of parameters leave few pairs (``contenders``); only these are added up for the bases, and they are bounded
again, by exact scores, before they are spread over the combinations (``top_scores``, which gives the lists themselves).
``grid_search`` asks for ranks only: ``query_gains`` has them from ``ranks``, without a row for a combination's score.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.config import Space
from lexispark.operators import metrics, ranks
from lexispark.operators.index import Index, query_terms
from lexispark.operators.scoring import BROADCAST_TERMS, Params, hinted, idf, matches, ranked, scores, weighted
from lexispark.staging import Stage

KINDS = ("rsj", "smoothed")
#: (b, idf) columns that one aggregation adds up (more of them leave generated code behind).
BASES_AT_ONCE = 44
#: More than the rounding of ``ranked``, so that equal scores are not told apart by a bound.
TIES = 1e-8
#: Ranges of k1 and of b that ``contenders`` bounds a score over: more of them are tighter, and more columns.
RANGES = (2, 2)
#: With more than so many times top_k contenders a query, the best documents of each query bound the others too.
CROWDED = 2
#: Queries that ``query_gains`` takes at once: each document is held against all of them.
QUERIES_AT_ONCE = 1000
#: Ranges of k1 and of b that ``query_gains`` bounds scores over, one level after the other; the last has each value alone.
LEVELS = ((2, 2), (4, 4), (1 << 30, 1 << 30))


COMBO = "combo_id int, k1 double, b double, k3 double, delta double, idf_type string"


def combos(spark, space: Space) -> DataFrame:
    return spark.createDataFrame(space.combos(), COMBO)


def _chunks(space: Space) -> list[list[tuple]]:
    """The (b, idf_type) bases, in lists that one aggregation takes as its columns."""
    bases = [(float(b), i) for b, i in product(space.b, space.idf_type)]
    return [bases[i : i + BASES_AT_ONCE] for i in range(0, len(bases), BASES_AT_ONCE)]


def _relative(index: Index) -> str:
    """A document's length by the mean one, in SQL; without a mean length the length does not count."""
    return f"dl / {index.avgdl!r}D" if index.avgdl > 0 else "1D"


def _sums(index: Index, query_term: DataFrame, space: Space, bases: list[tuple], only: DataFrame | None = None) -> DataFrame:
    """(q_idx, doc_idx, k1, k3, a0, a1, ..., i_rsj, i_smoothed): each base's sum for each k1 and k3, and the sums of the weights.

    Postings are read once and added up for all bases of the list, by document, k1 and query frequency; k3 comes later.
    ``only`` (q_idx, doc_idx) restricts the pairs.
    """
    n, bs = F.lit(index.doc_count), sorted({b for b, _ in bases})
    rows = matches(index, query_term, "qtf", *[idf(n, F.col("df"), kind).alias(f"w_{kind}") for kind in KINDS], among=only)
    rows = rows.select("q_idx", "doc_idx", "qtf", *[f"w_{kind}" for kind in KINDS], F.col("tf").cast("double").alias("tf"), F.expr(_relative(index)).alias("_r"), F.explode(_doubles(space.k1)).alias("k1"))
    parts = [f"tf * (k1 + 1D) / (tf + k1 * ({1.0 - b!r}D + {b!r}D * _r)) as _t{n}" for n, b in enumerate(bs)]
    rows = rows.selectExpr("q_idx", "doc_idx", "k1", "qtf", *[f"w_{kind}" for kind in KINDS], *parts)
    weights = [F.expr(f"sum(i_{kind}) as i_{kind}") for kind in KINDS]
    by_qtf = rows.groupBy("q_idx", "doc_idx", "k1", "qtf").agg(*[F.expr(f"sum(w_{kind} * _t{bs.index(b)}) as a{j}") for j, (b, kind) in enumerate(bases)], *[F.expr(f"sum(w_{kind}) as i_{kind}") for kind in KINDS])
    q, k3 = F.col("qtf").cast("double"), F.col("k3")
    each = by_qtf.withColumn("k3", F.explode(_doubles(space.k3)))
    each = each.withColumn("_s", F.when((q > 1) & (k3 > 0), q * (k3 + 1) / (q + k3)).otherwise(1.0))
    return each.groupBy("q_idx", "doc_idx", "k1", "k3").agg(*[F.expr(f"sum(a{j} * _s) as a{j}") for j in range(len(bases))], *weights)


def _doubles(values):
    return F.array(*[F.lit(float(x)) for x in values])


def _spread(sums: DataFrame, space: Space, bases: list[tuple], keep=None) -> DataFrame:
    """(combo_id, q_idx, k1, doc_idx, score) of the rows of ``_sums``; ``keep`` says (in SQL) which bases of a row stay."""
    one = [f"named_struct('b', {b!r}D, 'idf_type', '{kind}', 'a', a{j}, 'i', i_{kind})" for j, (b, kind) in enumerate(bases)]
    if keep is not None:
        one = [f"if({keep(j, kind)}, {x}, null)" for j, ((_, kind), x) in enumerate(zip(bases, one))]
    rows = sums.select("q_idx", "doc_idx", "k1", "k3", F.expr(f"filter(array({', '.join(one)}), x -> x is not null)").alias("_kept"))
    if keep is not None:  # what stays is dealt by what is ranked together, so that the scores of the combinations are not shuffled
        rows = rows.where("size(_kept) > 0").repartition(int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions")), "q_idx", "k1")
    rows = rows.selectExpr("q_idx", "doc_idx", "k1", "k3", "inline(_kept)")
    each = rows.join(F.broadcast(combos(sums.sparkSession, space)), ["k1", "b", "k3", "idf_type"])
    return each.select("combo_id", "q_idx", "k1", "doc_idx", (F.col("a") + F.col("delta") * F.col("i")).alias("score")).where("score != 0")


def combo_scores(index: Index, query_term: DataFrame, space: Space) -> DataFrame:
    """(combo_id, q_idx, k1, doc_idx, score) of every combination."""
    return reduce(DataFrame.unionByName, [_spread(_sums(index, query_term, space, x), space, x) for x in _chunks(space)])


def _parts(values, most: int) -> list[list[float]]:
    """At most ``most`` lists of neighbours."""
    v = sorted({float(x) for x in values})
    step = -(-len(v) // most)
    return [v[i : i + step] for i in range(0, len(v), step)]


def _bar(sums: DataFrame, space: Space, bases: list[tuple], name: str) -> DataFrame:
    """(q_idx, k1, k3, _n, low and high of each base): the least scores of a query's rows of ``_sums``, at both ends of delta."""
    least = [F.expr(f"min({_at(j, kind, d)}) as {name}_{end}{j}") for j, (_, kind) in enumerate(bases) for end, d in zip(("low", "high"), _ends(space))]
    return sums.groupBy("q_idx", "k1", "k3").agg(F.count("*").alias("_n"), *least)


def _ends(space: Space) -> tuple[float, float]:
    return float(min(space.delta)), float(max(space.delta))


def _at(j: int, kind: str, delta: float) -> str:
    return f"a{j} + {delta!r}D * i_{kind}"


def contenders(index: Index, query_term: DataFrame, space: Space, bars: list[DataFrame], stage: Stage) -> DataFrame:
    """(q_idx, doc_idx): the pairs that a bound does not prove to be below ``bars`` in every combination, and few others.

    ``bars`` has a ``_bar`` "r" for each list of ``_chunks``; a query without one has no contender. For a range of k1 and
    of b, the largest saturated frequency of a posting is at the least length norm and at one end of k1, and the smallest
    one at the largest norm (it is monotone in k1 and in the norm, the norm in b). So a document's sum over a range is at
    most the sum of its postings' largest parts (smallest ones for negative weights), and k3 is bounded by its ends.
    """
    cells = [(ks, bs, kind) for ks in _parts(space.k1, RANGES[0]) for bs in _parts(space.b, RANGES[1]) for kind in space.idf_type]
    parts = []
    for bases, bar in zip(_chunks(space), bars):
        low = []
        for c, (ks, bs, kind) in enumerate(cells):
            own = [j for j, (b, i) in enumerate(bases) if b in bs and i == kind]
            low += [f"if(k1 between {ks[0]!r}D and {ks[-1]!r}D, array_min(array({', '.join(f'r_{end}{j}' for j in own) or 'cast(null as double)'})), null) as {end}{c}" for end in ("low", "high")]
        parts.append(bar.selectExpr("q_idx", *low))
    names = [f"{end}{c}" for c in range(len(cells)) for end in ("low", "high")]
    least = reduce(DataFrame.unionByName, parts).groupBy("q_idx").agg(*[F.min(x).alias(x) for x in names])
    n, q = F.lit(index.doc_count), F.col("qtf").cast("double")
    repeats = [F.when((q > 1) & F.lit(k3 > 0), q * (k3 + 1) / (q + k3)).otherwise(1.0) for k3 in (float(min(space.k3)), float(max(space.k3)))]
    weight = {kind: idf(n, F.col("df"), kind) for kind in KINDS}
    columns = [w.alias(f"w_{kind}") for kind, w in weight.items()] + [(w * F.when(w < 0, repeats[0]).otherwise(repeats[1])).alias(f"u_{kind}") for kind, w in weight.items()]
    rows = matches(index, query_term, *columns).withColumn("tf", F.col("tf").cast("double")).withColumn("_r", F.expr(_relative(index)))

    def bound(ks, bs, kind):
        norms = ", ".join(f"{1.0 - b!r}D + {b!r}D * _r" for b in (bs[0], bs[-1]))
        ends = lambda pick: ", ".join(f"tf * {k + 1.0!r}D / (tf + {k!r}D * {pick}({norms}))" for k in (ks[0], ks[-1]))
        return f"u_{kind} * if(u_{kind} >= 0, greatest({ends('least')}), least({ends('greatest')}))"

    sums = rows.groupBy("q_idx", "doc_idx").agg(*[F.expr(f"sum({bound(*x)}) as a{c}") for c, x in enumerate(cells)], *[F.expr(f"sum(w_{kind}) as i_{kind}") for kind in KINDS])
    below = [" and ".join(f"{_at(c, kind, d)} < {end}{c} - {TIES!r}D" for end, d in zip(("low", "high"), _ends(space))) for c, (_, _, kind) in enumerate(cells)]
    return sums.join(hinted(stage.table(least)), "q_idx").where(f"not ({' and '.join(below)})").select("q_idx", "doc_idx")


def top_scores(index: Index, query_term: DataFrame, space: Space, top_k: int, wanted: DataFrame | None = None, stage: Stage | None = None) -> DataFrame:
    """The rows of ``combo_scores`` that can be among the best ``top_k`` of their combination and query: all that are,
    and few others. With ``wanted`` (q_idx, doc_idx) only ranks of these count: rows below all of their query's go too.

    Any ``top_k`` documents are a yardstick: whoever scores below all of them in a combination is not among its best; the
    best ones of a combination in the middle are taken. A score is linear in delta, and the least score of a yardstick
    (or of the wanted documents) is concave in it, so a base is ruled out if both ends of delta are below. Scores of 0 are
    no hits, so only a positive least score of a yardstick rules out anything; a wanted document of score 0 needs no rank.
    Each step is staged, so that no plan holds those before it.
    """
    chunks, among, crowded = _chunks(space), None, True
    stage = stage or Stage(query_term.sparkSession, "grid")
    # A bar is a row for each query, k1 and k3: no more than the query terms for each of them, which are counted once.
    few = F.broadcast if query_term.limit(BROADCAST_TERMS + 1).count() * len(space.k1) * len(space.k3) <= BROADCAST_TERMS else lambda df: df
    if wanted is not None:
        asked = stage.table(wanted.select("q_idx", "doc_idx").distinct())
        bars = [stage.table(_bar(_sums(index, query_term, space, x, asked), space, x, "r").drop("_n")) for x in chunks]
        if min(space.k1) >= 0 and min(space.b) >= 0 and max(space.b) <= 1 and min(space.k3) >= 0:  # else the bounds do not hold
            among = stage.table(contenders(index, query_term, space, bars, stage))
            crowded = among.count() > CROWDED * top_k * asked.select("q_idx").distinct().count()
    if crowded:
        mid = lambda x: sorted(x)[len(x) // 2]
        first = ranked(scores(index, query_term, Params(mid(space.k1), mid(space.b), mid(space.k3), mid(space.delta), space.idf_type[0]), among), top_k)
        only = stage.table(first.select("q_idx", "doc_idx"))  # top_k rows of each judged query
    out = []
    for n, bases in enumerate(chunks):
        pairs, tests = _sums(index, query_term, space, bases, among), []
        test = lambda j, kind, name, more="": " and ".join(f"{_at(j, kind, d)} < {name}_{end}{j} - {TIES!r}D{more.format(f'{name}_{end}{j}')}" for end, d in zip(("low", "high"), _ends(space)))
        if wanted is not None:
            pairs = pairs.join(few(bars[n]), ["q_idx", "k1", "k3"])
            tests.append(lambda j, kind, test=test: test(j, kind, "r"))
        if crowded:
            yard = _bar(_sums(index, query_term, space, bases, only), space, bases, "y").where(F.col("_n") >= top_k).drop("_n")
            pairs = pairs.join(few(yard), ["q_idx", "k1", "k3"], "left")
            tests.append(lambda j, kind, test=test: f"coalesce({test(j, kind, 'y', ' and {} > 0')}, false)")
        keep = lambda j, kind, tests=tests: " and ".join(f"not ({x(j, kind)})" for x in tests)
        out.append(_spread(pairs, space, bases, keep))
    return reduce(DataFrame.unionByName, out)


def query_gains(index: Index, terms: DataFrame, wanted: DataFrame, ideal: DataFrame, space: Space, top_k: int, stage: Stage) -> DataFrame:
    """(combo_id, mrr, ndcg, recall) of each query of ``terms``, in three readings of its documents' postings.

    The first finds good documents at ``_points``, the second has their scores and those of the relevant ones in every
    combination; so it is known which relevant documents can be among the best ``top_k``, and what score a document needs
    to stand above one of them. The third leaves the documents that a bound does not prove to be below; these are ranked.
    """
    spark, parts = terms.sparkSession, int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = terms.toArrow()  # of QUERIES_AT_ONCE queries
    numbers = {t: i for i, t in enumerate(sorted(set(rows["term"].to_pylist())))}
    side = ranks.Side(rows["q_idx"].to_numpy(), np.array([numbers[t] for t in rows["term"].to_pylist()]), rows["qtf"].to_numpy(), rows["df"].to_numpy(), len(numbers), index.doc_count, index.avgdl)
    ids = hinted(spark.createDataFrame(list(numbers.items()), "term string, id int"))
    slim = index.postings.join(ids, "term").groupBy("doc_idx", "dl").agg(F.collect_list(F.struct("id", "tf")).alias("hits"))
    slim = stage.table(slim)
    judged = lambda matches: matches.join(hinted(wanted), ["q_idx", "doc_idx"], "left").join(hinted(ideal), "q_idx").repartition(parts, "q_idx").groupBy("q_idx")
    deltas, levels = [float(x) for x in space.delta], []
    if min(space.k1) >= 0 and min(space.b) >= 0 and max(space.b) <= 1 and min(space.k3) >= 0:  # else the bounds do not hold
        good = slim.mapInArrow(ranks.leaders(side, _points(space), top_k), "q_idx long, point int, doc_idx long, score double")
        known = ranked(stage.table(good), top_k, ("q_idx", "point")).select("q_idx", "doc_idx").union(wanted.select("q_idx", "doc_idx"))
        known = stage.table(known.groupBy("doc_idx").agg(F.collect_set("q_idx").alias("asked")))
        near = slim.join(hinted(known), "doc_idx").mapInArrow(ranks.asked(side), ranks.MATCH)
        found = stage.table(judged(near).applyInArrow(ranks.bars_of(space, index.doc_count, top_k), "q_idx long, bars array<double>"))
        bars = np.full((len(side.ids), len(space.k1), len(space.b), len(space.idf_type), len(deltas)), np.inf)  # without relevant documents there is no bar to reach
        for r in found.collect():  # a row for each of these queries
            bars[np.searchsorted(side.ids, r["q_idx"])] = np.reshape(r["bars"], bars.shape[1:])
        for most in LEVELS:
            k1s, bs = _parts(space.k1, most[0]), _parts(space.b, most[1])
            place = lambda values, x: [i for i, v in enumerate(values) if float(v) in x]
            lows = [bars[:, place(space.k1, x)][:, :, place(space.b, y)].min((1, 2)) for x, y in product(k1s, bs)]
            levels.append((list(product(k1s, bs, space.idf_type)), np.concatenate(lows, 1)))
    few = stage.table(slim.mapInArrow(ranks.contenders(side, levels, deltas, (float(min(space.k3)), float(max(space.k3)))), ranks.MATCH))
    return stage.table(judged(few).applyInArrow(ranks.gains_of(space, index.doc_count, top_k), "combo_id int, mrr double, ndcg double, recall double"))


def _points(space: Space) -> list[tuple]:
    """The ends and the middle of b, with the middle of the other parameters."""
    mid = lambda x: float(sorted(x)[len(x) // 2])
    return [(mid(space.k1), b, mid(space.k3), mid(space.delta), space.idf_type[0]) for b in sorted({float(min(space.b)), mid(space.b), float(max(space.b))})]


def grid_search(index: Index, queries: DataFrame, qrels: DataFrame, space: Space = Space(), top_k: int = 100, limit_queries: int | None = None) -> DataFrame:
    """Each combination with its metrics; only judged queries are scored. ``queries`` has q_idx, qid, query."""
    stage = Stage(queries.sparkSession, "grid")
    if limit_queries is not None:
        queries = queries.where(F.col("q_idx") < limit_queries)
    rel = metrics.relevance(qrels).join(queries.select("q_idx", "qid"), "qid")
    ideal = metrics.ideal(rel.select("qid", "doc_id", "relevance")).join(queries.select("q_idx", "qid"), "qid")
    judged = queries.join(hinted(rel.select("qid").distinct()), "qid", "left_semi")
    wanted = stage.table(index.ids(rel.select("q_idx", "doc_id", "relevance")).drop("doc_id"))
    ideal = stage.table(ideal.select("q_idx", "idcg", "n_rel"))
    terms = stage.table(weighted(index, query_terms(judged)).select("q_idx", "term", "qtf", "df"))
    asked = sorted(r[0] for r in terms.select("q_idx").distinct().collect())
    each = []
    for i in range(0, len(asked), QUERIES_AT_ONCE):
        some = f"q_idx between {asked[i]} and {asked[min(i + QUERIES_AT_ONCE, len(asked)) - 1]}"
        each.append(query_gains(index, terms.where(some), wanted.where(some), ideal, space, top_k, stage))
    n = judged.count()
    none = queries.sparkSession.createDataFrame([], "combo_id int, mrr double, ndcg double, recall double")
    sums = stage.table(reduce(DataFrame.unionByName, each or [none]).groupBy("combo_id").agg(*[F.sum(c).alias(c) for c in ("mrr", "ndcg", "recall")]))
    out = combos(queries.sparkSession, space).join(sums, "combo_id", "left")
    share = lambda c: (F.coalesce(F.col(c), F.lit(0.0)) / max(1, n))
    out = out.select("combo_id", "k1", "b", "k3", "delta", "idf_type", share("mrr").alias("mrr@10"), share("ndcg").alias("ndcg@10"), share("recall").alias("recall@100"), F.lit(n).cast("long").alias("num_queries"))
    return stage.result(out, sums)


def best(results: DataFrame, metric: str = "ndcg") -> DataFrame:
    """The row of the highest metric, the first combination of equal ones; unknown names mean NDCG."""
    name = {"mrr": "mrr@10", "mrr@10": "mrr@10", "recall": "recall@100", "recall@100": "recall@100"}.get(metric.lower(), "ndcg@10")
    return results.orderBy(F.round(f"`{name}`", 9).desc(), "combo_id").limit(1)


def table_entry(name: str, features: dict, index: Index, queries: DataFrame, qrels: DataFrame, space: Space = Space(), metric: str = "ndcg") -> tuple:
    """An entry of a parameter table: a corpus's statistics and its best combination (the defaults take part)."""
    d = Params()
    with_default = Space(*(tuple(sorted({*values, default})) for values, default in zip((space.k1, space.b, space.k3, space.delta), (d.k1, d.b, d.k3, d.delta))), space.idf_type)
    r = best(grid_search(index, queries, qrels, with_default), metric).first()
    return name, {k: float(v) for k, v in features.items() if v is not None}, (r["k1"], r["b"], r["k3"], r["delta"], r["idf_type"])
