"""The class that ties it together: index a corpus, choose parameters from its statistics, search."""

from __future__ import annotations

import math
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.config import Config
from lexispark.operators import index as indexing
from lexispark.operators import metrics, predict
from lexispark.operators.features import features
from lexispark.operators.scoring import Params, score_documents, search_many
from lexispark.sources import readers


def checked_top_k(top_k) -> int:
    try:
        k = operator.index(top_k)
    except TypeError:
        raise TypeError("top_k must be an integer") from None
    if k < 0:
        raise ValueError("top_k must not be negative")
    return k


class Retriever:
    """``Retriever(spark).index(docs, queries).search("some words")``."""

    def __init__(self, spark: SparkSession, docs=None, queries=None, table: predict.ParamTable | None = None, config: Config | None = None, stop: list[str] | None = None):
        self.config, self.stop = config or Config(), stop
        self.spark, self._index, self.params, self.features, self.params_source = spark, None, self.config.default_params, {}, "default"
        self.docs = self.qrels = self.queries = None
        if docs is not None:
            self.index(docs, queries, table)

    def index(self, docs, queries=None, table: predict.ParamTable | None = None) -> Retriever:
        """Index the corpus and set the parameters; one row of statistics comes to the driver."""
        rows = readers.corpus(self.spark, docs)
        if self._index is not None:
            self._index.unpersist()
        self.docs, self._index = rows, indexing.build(rows, self.stop).persist()
        if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
            raise ValueError("document ids must be unique")
        terms = None
        if queries is not None:
            self.queries = readers.query_set(self.spark, queries)
            if self.queries.limit(1).count():
                terms = indexing.query_terms(self.queries)
        wide = features(self._index, terms)
        self.features = {k: v for k, v in wide.first().asDict().items() if v is not None}
        self.params, self.params_source = predict.predict(self.features, self.config.coefficients), "heuristic"
        if table is not None:
            got = table.predict(self.spark.createDataFrame([self.features], wide.schema).withColumn("corpus_id", F.lit(0))).first()
            if got["source"] == "dictionary":
                self.params, self.params_source = Params(got["k1"], got["b"], got["k3"], got["delta"], got["idf_type"]), "dictionary"
        return self

    @classmethod
    def from_dataset(cls, spark: SparkSession, path: str, max_docs: int | None = None, table: predict.ParamTable | None = None, config: Config | None = None, stop: list[str] | None = None) -> Retriever:
        docs, queries, qrels = readers.dataset(spark, path, max_docs)
        out = cls(spark, docs, queries, table, config, stop)
        out.qrels = qrels
        return out

    def _ready(self) -> indexing.Index:
        if self._index is None:
            raise RuntimeError("there is no index yet: call index() first")
        return self._index

    def set_params(self, k1=None, b=None, k3=None, delta=None, idf_type=None) -> Retriever:
        """Change some parameters; the index stays."""
        self.params = self.params.updated(k1=k1, b=b, k3=k3, delta=delta, idf_type=idf_type)
        return self

    def search(self, query: str, top_k: int = 10) -> list[tuple[str, float]]:
        rows = self.search_many([query], top_k).orderBy("rank").collect()  # at most top_k
        return [(r["doc_id"], r["score"]) for r in rows]

    def search_many(self, queries, top_k: int = 10) -> DataFrame:
        """(q_idx, rank, doc_idx, doc_id, score) of many queries at once."""
        index, k = self._ready(), checked_top_k(top_k)
        return search_many(index, readers.query_set(self.spark, queries).select("q_idx", "query"), self.params, k)

    def score_doc(self, term: str, doc_idx: int) -> float:
        got = score_documents(self._ready(), term, self.params, doc_idx).first()
        return got["score"] if got else 0.0

    def evaluate(self, queries=None, qrels: DataFrame | None = None, top_k: int = 100, params: Params | None = None) -> DataFrame:
        queries = self.queries if queries is None else readers.query_set(self.spark, queries)
        hits = search_many(self._ready(), queries.select("q_idx", "query"), params or self.params, checked_top_k(top_k))
        return metrics.evaluate(hits, queries, self.qrels if qrels is None else qrels)

    @property
    def doc_count(self) -> int:
        return self._ready().doc_count

    @property
    def total_tokens(self) -> int:
        return self._ready().total_tokens

    @property
    def avgdl(self) -> float:
        return self._ready().avgdl

    @property
    def vocab_size(self) -> int:
        return self._ready().vocab_size

    def doc_freq(self, term: str) -> int:
        return self._ready().doc_freq(term)

    def idf(self, term: str) -> float:
        """The weight of a term under the present parameters; an unknown term has none."""
        index, df = self._ready(), self.doc_freq(term)
        if not df:
            return 0.0
        n = index.doc_count
        return math.log((n - df + 0.5) / (df + 0.5)) if self.params.idf_type == "rsj" else math.log((n + 1) / (df + 1))

    def doc_lengths(self) -> DataFrame:
        return self._ready().documents

    def explain(self, queries) -> None:
        self.search_many(queries).explain("formatted")


def evaluate(spark: SparkSession, docs, queries, qrels: DataFrame, params: Params | dict | None = None, top_k: int = 100) -> DataFrame:
    """Index ``docs``, search ``queries`` with ``params`` (what is missing or None keeps its default) and score the
    rankings: one row of metrics."""
    given = params if isinstance(params, Params) else Params().updated(**(params or {}))
    index = indexing.build(readers.corpus(spark, docs)).persist()
    asked = readers.query_set(spark, queries)
    return metrics.evaluate(search_many(index, asked.select("q_idx", "query"), given, checked_top_k(top_k)), asked, qrels)
