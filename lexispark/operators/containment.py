"""Which documents contain a query's text whole, found through the index instead of by comparing every pair.

A text that contains a query holds the query's inner tokens as tokens of its own (its first and last one may be parts
of longer tokens). So the rarest inner token's postings are the candidates of a query of three tokens or more; for a
shorter one they are the postings of the terms that contain its longest token. Candidates are verified on the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import let, tokens
from lexispark.operators.index import Index
from lexispark.operators.scoring import hinted


def anchors(index: Index, queries: DataFrame) -> DataFrame:
    """(q_idx, term): terms, one of which each containing document must hold. ``queries`` has q_idx and query."""
    rows = queries.select("q_idx", tokens(F.col("query")).alias("_t")).where(F.size("_t") > 0)
    inner = rows.where(F.size("_t") > 2).select("q_idx", F.explode(F.slice("_t", F.lit(2), F.size("_t") - 2)).alias("term")).distinct()
    known = inner.join(index.terms.select("term", "df"), "term", "left")
    rarest = known.groupBy("q_idx").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    final = lambda c: F.translate(c, "ς", "σ")  # noqa: E731  its lower case depends on what follows
    longest = let(F.array_sort(F.transform("_t", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda x: F.get(x, 0)["x"])
    short = rows.where(F.size("_t") <= 2).select("q_idx", longest.alias("part"))
    # Short queries against the vocabulary: a term for each row, not a document.
    wider = index.terms.select("term").join(hinted(short), final(F.col("term")).contains(final(F.col("part")))).select("q_idx", "term")
    return rarest.select("q_idx", "term").unionByName(wider)


def containing(index: Index, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_idx, doc_idx) where the document's text contains the query's text; queries without a token contain nothing.

    ``docs`` has doc_idx and text, ``queries`` q_idx and query.
    """
    terms = hinted(anchors(index, queries).persist())
    found = index.postings.select("doc_idx", "term").join(terms, "term").select("q_idx", "doc_idx").distinct()
    met = docs.select("doc_idx", "text").join(found, "doc_idx").join(hinted(queries.select("q_idx", "query")), "q_idx")
    return met.where(F.col("text").contains(F.col("query"))).select("q_idx", "doc_idx")
