"""Subsamples: stratified by judgements, at random by a hash, and by length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(id_column: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")))


def stratified(docs: DataFrame, qrels: DataFrame, max_docs: int, seed: int = 42) -> DataFrame:
    """All judged-relevant documents first (up to ``max_docs``, in document order), then others by a hash of the id.

    ``docs`` has doc_idx, doc_id, text. Judged ids count against the budget even where the corpus lacks them.
    """
    ids = qrels.where("relevance > 0").select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    budget = max(0, max_docs - min(ids.count(), max_docs))
    good = docs.join(ids, "doc_id", "left_semi").orderBy("doc_idx").limit(max_docs)
    rest = docs.join(ids, "doc_id", "left_anti").orderBy(hash_order("doc_id", seed), "doc_idx").limit(budget)
    return good.withColumn("relevant", F.lit(True)).unionByName(rest.withColumn("relevant", F.lit(False)))


def kept_qrels(qrels: DataFrame, docs: DataFrame) -> DataFrame:
    """Positive judgements of documents that are in the sample."""
    return qrels.where("relevance > 0").join(docs.select("doc_id"), "doc_id", "left_semi")


def random_share(docs: DataFrame, share: float, seed: int) -> DataFrame:
    """Each document with probability ``share``, by a hash of its id: no shuffle, the same rows on every run."""
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def length_buckets(documents: DataFrame, buckets: int) -> DataFrame:
    """Bucket 1..n by length (dl), at the approximate quantiles of a mergeable sketch instead of a global sort."""
    cuts = documents.stat.approxQuantile("dl", [i / buckets for i in range(1, buckets)], 0.001)
    number = F.lit(1)
    for c in cuts:
        number = number + (F.col("dl") > c).cast("int")
    return documents.withColumn("bucket", number)
