"""BM25 and BM25+ scores of whole query sets, and ranked top-k lists.

Query terms, with their weights, join the postings on the term by broadcast (after a count; beyond the bound both
sides are shuffled). All postings of a document are in one partition of a kept index, so its scores are summed up
there without a shuffle, and the ranked window carries at most k rows of a query from each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.config import Params
from lexispark.operators.index import Index
from lexispark.staging import small

#: A query-term table of at most so many rows is broadcast; a longer one is shuffled with the postings.
BROADCAST_TERMS = 500_000


def idf(n: Column, df: Column, kind: str) -> Column:
    n, df = n.cast("double"), df.cast("double")
    if kind == "rsj":
        return F.log((n - df + 0.5) / (df + 0.5))
    if kind == "smoothed":
        return F.log((n + 1.0) / (df + 1.0))
    raise ValueError(f"unknown idf_type {kind!r}")


def tf_part(tf: Column, dl: Column, avgdl: Column, k1: Column | float, b: Column | float) -> Column:
    """Saturated term frequency; without a mean length the length does not count."""
    k1, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (k1, b))
    tf = tf.cast("double")
    norm = F.when(avgdl > 0, k1 * (1.0 - b + b * dl.cast("double") / F.when(avgdl > 0, avgdl))).otherwise(k1)
    return tf * (k1 + 1.0) / (tf + norm)


def qtf_part(qtf: Column, k3: float) -> Column:
    """Saturated query frequency, for terms that a query repeats."""
    q = qtf.cast("double")
    return F.when(q > 1, q * (k3 + 1.0) / (q + k3)).otherwise(1.0) if k3 > 0 else F.lit(1.0)


def hinted(side: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """A broadcast hint, after a count has shown that the side is small."""
    return small(side, most)


def weighted(index: Index, query_term: DataFrame) -> DataFrame:
    """``query_term`` (q_idx, term, qtf, ...) with the document frequency ``df``, if it has none yet; unknown terms fall away."""
    if "df" in query_term.columns:
        return query_term
    return query_term.join(index.terms.select("term", "df"), "term")  # no more rows than the query terms


def matches(index: Index, query_term: DataFrame, *columns: str | Column, among: DataFrame | None = None) -> DataFrame:
    """(q_idx, doc_idx, tf, dl, columns): postings of the queries' terms; ``columns`` are made from a query term's row
    (q_idx, term, qtf, df) before it meets the postings. ``among`` (q_idx, doc_idx; kept) restricts the pairs: it meets
    the documents by doc_idx alone, so that no posting is shuffled."""
    wanted = weighted(index, hinted(query_term)).select("q_idx", "term", *columns)
    wanted = F.broadcast(wanted) if query_term.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else wanted
    if among is None:
        return index.postings.join(wanted, "term").drop("term")
    asked = among.groupBy("doc_idx").agg(F.collect_set("q_idx").alias("_asked"))
    rows = index.postings_of(F.broadcast(asked) if among.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else asked).join(wanted, "term")
    return rows.where(F.array_contains("_asked", F.col("q_idx"))).drop("term", "_asked")


def scores(index: Index, query_term: DataFrame, params: Params, among: DataFrame | None = None) -> DataFrame:
    """(q_idx, doc_idx, score), scores of exactly 0 dropped and negative ones kept; ``among`` restricts the pairs."""
    weight = idf(F.lit(index.doc_count), F.col("df"), params.idf_type)
    rows = matches(index, query_term, (weight * qtf_part(F.col("qtf"), params.k3)).alias("w"), (weight * float(params.delta)).alias("more"), among=among)
    part = F.col("w") * tf_part(F.col("tf"), F.col("dl"), F.lit(index.avgdl), params.k1, params.b)
    if params.delta:
        part = part + F.col("more")
    return rows.groupBy("q_idx", "doc_idx").agg(F.sum(part).alias("score")).where("score != 0")


def ranked(scored: DataFrame, top_k: int, keys: tuple[str, ...] = ("q_idx",)) -> DataFrame:
    """The k best documents of each key: higher scores first, equal ones (to nine digits) by doc_idx."""
    order = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), F.col("doc_idx"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def search_many(index: Index, queries: DataFrame, params: Params, top_k: int = 10) -> DataFrame:
    """(q_idx, rank, doc_idx, doc_id, score) for ``queries`` (q_idx, query)."""
    from lexispark.operators.index import query_terms

    hits = ranked(scores(index, query_terms(queries), params), top_k)
    return hits.join(index.documents.select("doc_idx", "doc_id"), "doc_idx").select("q_idx", "rank", "doc_idx", "doc_id", "score")


def score_documents(index: Index, term: str, params: Params, doc_idx: int | None = None) -> DataFrame:
    """(doc_idx, tf, dl, score) of one term's postings, without query frequency; an unknown term has none."""
    rows = index.postings.where(F.col("term") == term)
    if doc_idx is not None:
        rows = rows.where(F.col("doc_idx") == doc_idx)
    weight = idf(F.lit(index.doc_count), F.lit(index.doc_freq(term)), params.idf_type)
    part = weight * tf_part(F.col("tf"), F.col("dl"), F.lit(index.avgdl), params.k1, params.b) + weight * float(params.delta)
    return rows.select("doc_idx", "tf", "dl", part.alias("score"))
