"""The inverted index as tables: documents with their term counts, postings, terms and corpus scalars.

Term counts are made inside each document's row, and rows are dealt by document, so neither building the index nor
adding up a document's score needs a shuffle of postings. Postings are the exploded counts; a saved index has them
sorted by term inside each file, so that a reader's filter on terms skips row groups, and it has the terms' document
frequencies and the corpus scalars of every batch that was added. Every table can carry a leading ``corpus_id``,
which indexes many small corpora in one job.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import counts, stop_words, tokens
from lexispark.sources.readers import exists
from lexispark.staging import Stage, ordinals

ID = "corpus_id"


@dataclass
class Index:
    """Lazy tables over one or more corpora; ``keys`` is [] or ["corpus_id"]."""

    rows: DataFrame  # keys, doc_idx, doc_id, dl, uniq, max_tf, stop_tokens, counts, and what the caller carried along
    stop: list[str]
    keys: list[str] = field(default_factory=list)
    kept_postings: DataFrame | None = None
    kept_terms: DataFrame | None = None
    kept_corpus: DataFrame | None = None
    kept: bool = False

    @property
    def documents(self) -> DataFrame:
        return self.rows.select(*self.keys, "doc_idx", "doc_id", "dl")

    @property
    def postings(self) -> DataFrame:
        if self.kept_postings is not None:
            return self.kept_postings
        return self.rows.select(*self.keys, "doc_idx", "dl", F.inline("counts"))

    def postings_of(self, docs: DataFrame) -> DataFrame:
        """The postings of ``docs`` (doc_idx, ...), with its columns: other documents' counts are not exploded."""
        more = [c for c in docs.columns if c != "doc_idx"]
        if self.kept_postings is not None:
            return self.kept_postings.join(docs, "doc_idx")
        return self.rows.join(docs, "doc_idx").select(*self.keys, "doc_idx", "dl", *more, F.inline("counts"))

    @property
    def terms(self) -> DataFrame:
        """Document frequency, collection frequency and first document of each term."""
        if self.kept_terms is None:
            once = self.postings.groupBy(*self.keys, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min("doc_idx").alias("first_doc"))
            if not self.kept:
                return once
            self.kept_terms = once.persist(StorageLevel.MEMORY_AND_DISK)
        return self.kept_terms

    @property
    def corpus(self) -> DataFrame:
        """Documents, tokens and mean length: one row for each corpus, empty documents counted."""
        if self.kept_corpus is not None:
            return self.kept_corpus
        return corpus_of(self.rows.groupBy(*self.keys), F.count("*"), F.sum("dl"))

    @cached_property
    def scalars(self):
        """Documents, tokens and mean length of a single corpus, on the driver."""
        return self.corpus.first()

    @property
    def doc_count(self) -> int:
        return self.scalars["doc_count"]

    @property
    def total_tokens(self) -> int:
        return self.scalars["total_tokens"]

    @property
    def avgdl(self) -> float:
        return self.scalars["avgdl"]

    @property
    def vocab_size(self) -> int:
        return self.terms.count()

    def doc_freq(self, term: str) -> int:
        """Documents that hold a term; 0 for an unknown one."""
        found = self.terms.where(F.col("term") == term).select("df").first()
        return found["df"] if found else 0

    @property
    def document_stats(self) -> DataFrame:
        """Distinct terms, type-token ratio, largest count of a term that is no stop word, mean count and stop
        words of each document, also of the empty ones."""
        share = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(0.0))
        return self.rows.select(*self.keys, "doc_idx", "dl", "uniq", "max_tf", "stop_tokens", share("uniq", "dl").alias("ttr"), share("dl", "uniq").alias("mean_tf"))

    def ids(self, doc_ids: DataFrame) -> DataFrame:
        """``doc_ids`` (doc_id, ...) with the documents' doc_idx; unknown ids fall away."""
        return doc_ids.join(self.rows.select("doc_id", "doc_idx"), "doc_id")

    def persist(self) -> Index:
        """Keep the rows, and the terms once they are asked for, for a session of many queries (``Retriever`` does)."""
        self.rows.persist(StorageLevel.MEMORY_AND_DISK)
        self.kept = True
        return self

    def unpersist(self) -> None:
        self.rows.unpersist()
        if self.kept and self.kept_terms is not None:
            self.kept_terms.unpersist()
            self.kept_terms = None
        self.kept = False

    def by(self, column: str) -> Index:
        """The same documents as one corpus for each value of a carried column, without reading a text again.

        Positions are dense in each corpus, in the order of doc_id as text; a document without a value is in none.
        """
        spark = self.rows.sparkSession
        valued = self.rows.where(F.col(column).isNotNull())
        numbers = ordinals(valued.select("doc_idx", F.col(column).alias(ID), "doc_id"), "_at", [ID], ["doc_id"], Stage(spark, "corpora"))
        rows = valued.join(numbers.select("doc_idx", "_at"), "doc_idx").withColumn(ID, F.col(column))
        return Index(rows.withColumn("doc_idx", F.col("_at")).drop("_at", column), self.stop, [ID])

    def save(self, path: str) -> None:
        """Write the index as the batch ``base`` of a folder; ``streaming.ingest`` adds further batches beside it."""
        write_batch(self, path, "base", "error")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        """Everything that ``save`` and later batches wrote; df and the corpus scalars are sums of the batches' own."""
        read = lambda name: spark.read.parquet(f"{path}/{name}").drop("batch")
        stop = [r[0] for r in spark.read.parquet(f"{path}/stop").collect()] if exists(spark, f"{path}/stop") else stop_words(spark)
        rows = read("documents")
        keys = [c for c in (ID,) if c in rows.columns]
        terms = read("terms").groupBy(*keys, "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.min("first_doc").alias("first_doc"))
        corpus = corpus_of(read("corpus").groupBy(*keys), F.sum("doc_count"), F.sum("total_tokens"))
        return cls(rows, stop, keys, read("postings"), terms, corpus)


def corpus_of(grouped, documents: Column, tokens_: Column) -> DataFrame:
    n, total = F.coalesce(documents, F.lit(0)).cast("long"), F.coalesce(tokens_, F.lit(0)).cast("long")
    return grouped.agg(n.alias("doc_count"), total.alias("total_tokens"), F.coalesce(F.try_divide(total.cast("double"), n.cast("double")), F.lit(0.0)).alias("avgdl"))


def write_batch(index: Index, path: str, batch: str, mode: str) -> None:
    """One batch of a saved index: its documents, postings (sorted by term in each file), terms and corpus scalars."""
    to = lambda df, name: df.write.mode(mode).parquet(f"{path}/{name}/batch={batch}")
    to(index.rows, "documents")
    written = Index(index.rows.sparkSession.read.parquet(f"{path}/documents/batch={batch}"), index.stop, index.keys)
    to(written.postings.sortWithinPartitions("term", "doc_idx"), "postings")
    to(written.terms, "terms")
    to(written.corpus, "corpus")
    if batch == "base":
        spark = index.rows.sparkSession
        spark.createDataFrame([(w,) for w in index.stop], "word string").coalesce(1).write.mode(mode).parquet(f"{path}/stop")


def build(docs: DataFrame, stop: list[str] | None = None, carry: tuple[str, ...] = ()) -> Index:
    """Index ``docs`` (doc_idx, doc_id, text, and corpus_id if there are several corpora); ``carry`` names further
    columns to keep. One shuffle deals the documents (not their postings) by doc_idx; a table in few large files,
    or one file of one row group, is spread by it too."""
    spark = docs.sparkSession
    keys = [ID] if ID in docs.columns else []
    stop = stop if stop is not None else stop_words(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(*keys, F.col("doc_idx").cast("long").alias("doc_idx"), F.col("doc_id").cast("string").alias("doc_id"), *carry, "text")
    texts = texts.repartition(parts, "doc_idx")
    rows = texts.withColumn("_t", tokens(F.col("text"))).drop("text")
    rows = rows.withColumn("dl", F.size("_t").cast("int")).withColumn("counts", counts(F.col("_t"))).drop("_t")
    is_stop = lambda x: x["term"].isin(stop)
    tf = lambda x: x["tf"]
    return Index(
        rows.select(
            *keys, "doc_idx", "doc_id", *carry, "dl", F.size("counts").cast("long").alias("uniq"),
            F.coalesce(F.array_max(F.transform(F.filter("counts", lambda x: ~is_stop(x)), tf)), F.lit(0)).cast("long").alias("max_tf"),
            F.aggregate(F.filter("counts", is_stop), F.lit(0).cast("long"), lambda a, x: a + x["tf"]).alias("stop_tokens"), "counts",
        ),
        stop, keys,
    )


def counted_terms(rows: DataFrame, keys: list[str], token_array: str = "tokens") -> DataFrame:
    """(keys, term, n, first_pos): counts of each row's tokens, with the first position of each."""
    return (
        rows.select(*keys, F.posexplode(token_array).alias("pos", "term"))
        .groupBy(*keys, "term").agg(F.count("*").alias("n"), F.min("pos").cast("int").alias("first_pos"))
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """(q_idx, term, qtf, pos) of ``queries`` (q_idx, query); counted inside the row."""
    rows = queries.select("q_idx", tokens(F.col("query")).alias("_t"))
    rows = rows.select("q_idx", "_t", F.inline(counts(F.col("_t"))))
    return rows.select("q_idx", "term", F.col("tf").alias("qtf"), (F.array_position("_t", F.col("term")) - 1).cast("int").alias("pos"))
