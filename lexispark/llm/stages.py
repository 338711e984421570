"""The stages of ``corpus_pipeline``: each applies one operator and lets its decision take effect.

All take whole tables of ``documents`` (doc_id, text, ...), empty ones too; other columns pass unread, whatever their
names, and come back as they are. What a stage does with nulls, empty texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import dart_minhash, packing, secret_scan, toxicity, winnowing
from lexispark.llm.runtime import read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the factorization machine does not reject (score below 0.5).

    Null, empty and word-free texts stay; rows with a null doc_id are scored like others; equal texts, so repeated rows,
    share their fate; without labels of both classes nothing is rejected.
    """
    return toxicity.keep_clean(docs, toxicity.train(spark, docs, read(spark, sf_dir, "labels")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies the document of least doc_id stays, one row of it.

    Null texts stay (each doc_id is a group); of texts without a word only equal ones are copies; of rows that share a
    doc_id the one with the least text hash stays; rows with a null doc_id stay once for each text, unless a row with an
    id has it. Ties cannot occur: ids decide.
    """
    return dart_minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which no window of a benchmark item occurs.

    Null, empty and word-free texts, and all documents where no item has a word, stay; rows are judged by their text, so
    repeated rows share their fate, and a null doc_id makes no difference.
    """
    return winnowing.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in its text becomes a mark of its kind, overlapping ones one mark.

    Null and empty texts stay as they are; ``n_chars`` is set anew where something was cut; repeated rows are cut alike;
    without rows only generated strings and names train the models.
    """
    return secret_scan.redact(docs, secret_scan.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every remaining document.

    Null and empty texts have no tokens and are packed too; repeated rows and null ids get slots of their own; documents
    of equal length share a bucket; a document above the budget is a batch of its own.
    """
    return packing.packed_documents(docs)
