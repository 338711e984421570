"""A training-corpus pipeline over ``documents``: toxicity, near-duplicates, benchmark leaks, secrets, packing.

``STAGES`` are (name, function) pairs. A function takes (spark, docs, sf_dir), with docs what the stage before
kept; all but the last return the columns of ``documents``. ``run`` applies them in order, and each stage reads
its predecessor's rows from a Parquet table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import stages
from lexispark.llm.runtime import Stage, read

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("minhash_dedup", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_contaminated),
    ("secrets", stages.redact_secrets),
    ("packing", stages.pack),
]

#: The trained models and the signatures have no SQL form; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    written = Stage(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = written.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
