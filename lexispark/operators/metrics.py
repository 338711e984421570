"""MRR@10, NDCG@10 (linear gain) and Recall@100 of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAMES = ("mrr@10", "ndcg@10", "recall@100")


def relevance(qrels: DataFrame) -> DataFrame:
    """Positive judgements, the last of a repeated (qid, doc_id) counting; ``ordinal`` gives the order if there."""
    order = "ordinal" if "ordinal" in qrels.columns else "relevance"
    last = qrels.where("relevance > 0").groupBy("qid", "doc_id").agg(F.max_by("relevance", order).alias("relevance"))
    return last


def ideal(rel: DataFrame) -> DataFrame:
    """(qid, idcg, n_rel): the best ten gains of each judged query."""
    order = Window.partitionBy("qid").orderBy(F.col("relevance").desc(), "doc_id")
    gain = F.when(F.col("r") <= 10, F.col("relevance") / F.log2(F.col("r") + 1.0)).otherwise(0.0)
    return rel.withColumn("r", F.row_number().over(order)).groupBy("qid").agg(F.sum(gain).alias("idcg"), F.count("*").alias("n_rel"))


def gains() -> list:
    """Aggregates over a query's relevant hits (rank, relevance): first rank and gain of the top ten, hits of the top hundred."""
    return [
        F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= 10, F.col("relevance") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum((F.col("rank") <= 100).cast("long")).alias("found"),
    ]


def shares() -> list:
    """Reciprocal rank, NDCG and recall from ``gains`` and the query's ideal; 0 where nothing relevant was found."""
    zero = F.lit(0.0)
    return [
        F.coalesce(F.try_divide(zero + 1, F.col("first").cast("double")), zero).alias("mrr"),
        F.coalesce(F.try_divide(F.col("dcg"), F.col("idcg")), zero).alias("ndcg"),
        F.coalesce(F.col("found") / F.col("n_rel"), zero).alias("recall"),
    ]


def per_query(hits: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(q_idx, mrr, ndcg, recall) of each query with a positive judgement.

    ``hits`` has q_idx, rank, doc_id, ``queries`` q_idx and qid. No side is broadcast by force: the judgements may be
    many, and the ranked hits are small once they are shuffled, which adaptive execution sees.
    """
    rel = relevance(qrels)
    judged = queries.select("q_idx", "qid").join(ideal(rel), "qid")
    wanted = rel.join(queries.select("q_idx", "qid"), "qid").select("q_idx", "doc_id", "relevance")
    seen = hits.join(wanted, ["q_idx", "doc_id"]).groupBy("q_idx").agg(*gains())
    return judged.join(seen, "q_idx", "left").select("q_idx", *shares())


def evaluate(hits: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: the three means over the judged queries, and how many these are."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return per_query(hits, queries, qrels).agg(
        mean("mrr").alias("mrr@10"), mean("ndcg").alias("ndcg@10"), mean("recall").alias("recall@100"), F.count("*").alias("num_queries")
    )


def improvement(default: DataFrame, adaptive: DataFrame) -> DataFrame:
    """Percentage by which each metric improves; 0 where the default's is 0."""
    d, a = default.select(*[F.col(f"`{n}`").alias(f"d_{n}") for n in NAMES]), adaptive.select(*[F.col(f"`{n}`").alias(f"a_{n}") for n in NAMES])
    gain = lambda n: F.coalesce(F.try_divide((F.col(f"`a_{n}`") - F.col(f"`d_{n}`")) * 100, F.col(f"`d_{n}`")), F.lit(0.0))
    return d.join(F.broadcast(a)).select(*[gain(n).alias(f"improve_vs_default_{n}") for n in NAMES])
