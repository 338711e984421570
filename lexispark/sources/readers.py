"""Readers of documents, queries and judgements: JSON lines, TSV, Parquet, lists."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.staging import Stage

# Header names that a judgement file may use.
QID_NAMES = ("qid", "query-id", "query_id", "queryid")
DOC_NAMES = ("corpus_id", "corpus-id", "doc_id", "doc-id", "docid")
SCORE_NAMES = ("score", "relevance", "rel")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def files(spark: SparkSession, pattern: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().toString() for f in found or [])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A dense ordinal from 0 in file order, without gathering the rows: partitions are counted, then offset.

    The rows are staged first, so that counting and numbering see the same rows in the same order whatever ``df`` is.
    """
    rows = Stage(df.sparkSession, "numbered").table(df.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))  # one row for each partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    joined = rows.withColumn("_p", part).join(F.broadcast(offset), "_p")
    return joined.withColumn(name, (F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_m", "_p", "_o")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema (ids stay text, other fields are skipped); blank lines are left out, a bad one
    fails. Bytes that are no UTF-8 become the replacement character."""
    lines = spark.read.text(path).select(F.make_valid_utf8("value").alias("value")).where(F.trim(F.regexp_replace("value", "\r$", "")) != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _text(*names: str) -> Column:
    return F.coalesce(*[F.col(n) for n in names], F.lit(""))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_idx, doc_id, text) from ``docs.jsonl`` (title not used) or ``corpus.jsonl`` (title before the text)."""
    if exists(spark, f"{path}/docs.jsonl"):
        rows = jsonl(spark, f"{path}/docs.jsonl", "id string, text string").select(F.col("id").alias("doc_id"), _text("text").alias("text"))
    else:
        raw = jsonl(spark, f"{path}/corpus.jsonl", "_id string, title string, text string")
        body = F.when(_text("title") != "", F.concat_ws(" ", "title", _text("text"))).otherwise(_text("text"))
        rows = raw.select(F.col("_id").alias("doc_id"), body.alias("text"))
    return numbered(rows, "doc_idx").select("doc_idx", "doc_id", "text")


def queries(spark: SparkSession, path: str) -> DataFrame:
    """(q_idx, qid, query) from ``queries.jsonl``."""
    raw = jsonl(spark, f"{path}/queries.jsonl", "qid string, _id string, query string, text string")
    return numbered(raw.select(F.coalesce("qid", "_id").alias("qid"), _text("query", "text").alias("query")), "q_idx").select("q_idx", "qid", "query")


def tsv_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Positive judgements of one TSV file, whose header names the columns; short or non-integer rows are skipped."""
    lines = spark.read.text(path).withColumn("value", F.rtrim(F.regexp_replace("value", "\r$", "")))
    header = [h.strip().lower() for h in lines.first()["value"].split("\t")]
    at = [next(i for i, h in enumerate(header) if h in names) for names in (QID_NAMES, DOC_NAMES, SCORE_NAMES)]
    parts = lines.select(F.split("value", "\t").alias("p")).where(F.size("p") > max(at))
    rows = parts.select(F.col("p")[at[0]].alias("qid"), F.col("p")[at[1]].alias("doc_id"), F.expr(f"try_cast(p[{at[2]}] as int)").alias("relevance"))
    return rows.where("relevance > 0")  # the header's score is no number


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, relevance, ordinal) from ``qrels.jsonl`` or every ``qrels/*.tsv`` in order of name."""
    if exists(spark, f"{path}/qrels.jsonl"):
        rows = jsonl(spark, f"{path}/qrels.jsonl", "qid string, doc_id string, relevance int")
    else:
        rows = None
        for f in files(spark, f"{path}/qrels/*.tsv"):
            part = tsv_qrels(spark, f)
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = spark.createDataFrame([], "qid string, doc_id string, relevance int")
    return numbered(rows, "ordinal").select("qid", "doc_id", "relevance", "ordinal")


def dataset(spark: SparkSession, path: str, max_docs: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, queries and judgements of a folder; a subsample where ``max_docs`` is set and the layout is BEIR's."""
    docs, qs, rels = documents(spark, path), queries(spark, path), qrels(spark, path)
    if max_docs and exists(spark, f"{path}/corpus.jsonl"):
        from lexispark.operators import sampling

        kept = sampling.stratified(docs, rels, max_docs, seed)
        order = Window.orderBy(F.col("relevant").desc(), F.when(F.col("relevant"), F.col("doc_idx")), sampling.hash_order("doc_id", seed))
        kept = kept.withColumn("doc_idx", F.row_number().over(order).cast("long") - 1).drop("relevant")  # max_docs rows
        return kept, qs, sampling.kept_qrels(rels, kept)
    return docs, qs, rels


def corpus(spark: SparkSession, given) -> DataFrame:
    """(doc_idx, doc_id, text) from a DataFrame, texts, records, a text or a record."""
    if isinstance(given, DataFrame):
        df = given
        if "doc_id" not in df.columns and "id" in df.columns:
            df = df.withColumnRenamed("id", "doc_id")
        if not {"doc_id", "text"} <= set(df.columns):
            raise TypeError("documents need the columns doc_id (or id) and text")
        if df.limit(1).count() == 0:
            raise ValueError("the corpus must not be empty")
        if "doc_idx" not in df.columns:
            df = numbered(df, "doc_idx")
        return df.select("doc_idx", F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if isinstance(given, str) or (isinstance(given, Mapping) and {"id", "text"} <= set(given)):
        given = [given]
    if isinstance(given, Mapping) or not isinstance(given, Iterable):
        raise TypeError("the corpus must be texts or records with id and text")
    rows = []
    for i, d in enumerate(given):
        if isinstance(d, str):
            rows.append((i, str(i), d))
        elif isinstance(d, Mapping) and {"id", "text"} <= set(d):
            rows.append((i, str(d["id"]), str(d["text"])))
        else:
            raise TypeError(f"document {i} is neither a text nor a record with id and text")
    if not rows:
        raise ValueError("the corpus must not be empty")
    return spark.createDataFrame(rows, "doc_idx long, doc_id string, text string")


def query_set(spark: SparkSession, given) -> DataFrame:
    """(q_idx, qid, query) from a DataFrame, texts or records with qid and query."""
    if isinstance(given, DataFrame):
        return given if "q_idx" in given.columns else numbered(given, "q_idx")
    given = [given] if isinstance(given, str) else list(given)
    rows = [(i, str(i), q) if isinstance(q, str) else (i, str(q.get("qid", i)), str(q.get("query", ""))) for i, q in enumerate(given)]
    return spark.createDataFrame(rows, "q_idx long, qid string, query string")
