"""The queries of this subpackage: each applies its operator to its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm.runtime import read


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.projection_forest import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.warc import derivatives, responses_from_pages

    return derivatives(responses_from_pages(read(spark, sf_dir, "pages")))


def op2_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.packing import packed_documents

    return packed_documents(read(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.license_scan import licences

    return licences(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.toxicity import toxic_documents

    return toxic_documents(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.dart_minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.language_id import identified

    return identified(read(spark, sf_dir, "documents"))


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.preference import preference_rows

    return preference_rows(read(spark, sf_dir, "conversations"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.secret_scan import secrets

    return secrets(read(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexispark.llm.winnowing import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from lexispark.llm import dart_minhash, packing, preference, projection_forest, winnowing

    return {"op5_dart_minhash": dart_minhash.SQL, "op10_projection_forest": projection_forest.SQL, "op2_length_buckets": packing.SQL, "op7_preference": preference.SQL, "op9_winnowing": winnowing.SQL}
