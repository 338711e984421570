"""The registered queries over the driver's tables, and their SQL equivalents.

``documents`` is the corpus (doc_idx is doc_id), ``benchmark`` the query set, and a document that contains a
benchmark text whole is relevant to it, with ``1 + quality`` as the grade.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import text as txt
from lexispark.operators import features as feat
from lexispark.operators import containment, grid, index as indexing, metrics, predict, sampling, scoring
from lexispark.plans import oracle
from lexispark.sources import sinks

SPACE = grid.Space((0.5, 1.2, 2.0), (0.0, 0.4, 0.8), (0.0, 4.0), (0.0, 1.0), ("rsj", "smoothed"))
SMALL_SAMPLE = 200

#: What the queries of one folder share (index, judgements, parameter table), by name; the last folder's are kept.
_KEPT: dict[str, object] = {}
_FOLDER: list[tuple] = []


def _kept(spark: SparkSession, d: str, name: str, make: Callable):
    """``make()``, made once for a folder and session."""
    now = (spark.sparkContext.applicationId, d)
    if _FOLDER != [now]:
        release()
        _FOLDER[:] = [now]
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Free what is kept for the last folder; the next query makes it anew."""
    for x in _KEPT.values():
        try:
            x.unpersist() if hasattr(x, "unpersist") else None
        except Exception:  # noqa: BLE001  its session has ended, and the tables with it
            pass
    _KEPT.clear()
    _FOLDER.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc_idx"), F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q_idx"), F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def _index(spark: SparkSession, d: str) -> indexing.Index:
    """The corpus's index, kept for the session: it is built once and asked often."""
    return _kept(spark, d, "index", lambda: indexing.build(_docs(spark, d), carry=("lang", "source")).persist())


def _by(spark: SparkSession, d: str, column: str) -> indexing.Index:
    return _kept(spark, d, f"index by {column}", lambda: _index(spark, d).by(column).persist())


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return indexing.query_terms(_queries(spark, d))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def _features(spark: SparkSession, d: str) -> DataFrame:
    return feat.features(_index(spark, d), _terms(spark, d))


def _wide(spark: SparkSession, d: str, column: str) -> DataFrame:
    """The statistics of each corpus of a column, one row each, kept."""
    return _kept(spark, d, f"features by {column}", lambda: feat.features(_by(spark, d, column)).persist())


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    def made():
        q = _queries(spark, d)
        pairs = containment.containing(_index(spark, d), _docs(spark, d), q).join(q.select("q_idx", "qid"), "q_idx")
        graded = pairs.join(table(spark, d, "labels").select("doc_id", "quality"), F.col("doc_id") == F.col("doc_idx"), "left")
        return graded.select("qid", F.col("doc_idx").cast("string").alias("doc_id"), (1 + F.coalesce("quality", F.lit(0))).cast("int").alias("relevance")).persist()

    return _kept(spark, d, "judgements", made)


def _search(spark: SparkSession, d: str, params: scoring.Params, k: int) -> DataFrame:
    return scoring.search_many(_index(spark, d), _queries(spark, d).select("q_idx", "query"), params, k)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("q_idx", "rank", F.col("doc_idx"), F.round("score", 6).alias("score"))


def _adaptive(spark: SparkSession, d: str) -> scoring.Params:
    def made():
        r = predict.heuristic(_features(spark, d), []).first()
        return scoring.Params(r["k1"], r["b"], r["k3"], r["delta"], r["idf_type"])

    return _kept(spark, d, "adaptive parameters", made)


def _length(s, d):
    return _rounded(feat.length_features(_index(s, d)).drop(feat.ID))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """A parameter table of one entry for each source, with the formulas' parameters."""

    def made():
        wide = _wide(spark, d, "source")
        m = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.round(F.col(k).cast("double"), 9)) for k in feat.CORPUS_KEYS]))
        both = wide.select("corpus_id", m.alias("features")).join(predict.heuristic(wide, ["corpus_id"]), "corpus_id")
        return both.select(F.col("corpus_id").alias("name"), "features", F.struct("k1", "b", "k3", "delta", "idf_type").alias("params")).persist()

    return _kept(spark, d, "entries", made)


def _targets(spark: SparkSession, d: str) -> DataFrame:
    wide = _wide(spark, d, "lang")
    return wide.select("corpus_id", *[F.round(F.col(k).cast("double"), 9).alias(k) if k not in feat.QUERY_KEYS else F.col(k) for k in feat.FEATURE_KEYS])


def _table(spark: SparkSession, d: str, **settings) -> predict.ParamTable:
    return predict.ParamTable(_entries(spark, d), **settings)


def _long(spark: SparkSession, d: str) -> DataFrame:
    return feat.long_form(_targets(spark, d))


def _evaluated(spark: SparkSession, d: str, params: scoring.Params) -> DataFrame:
    return metrics.evaluate(_search(spark, d, params, 100), _queries(spark, d), _qrels(spark, d))


def _snippets(s, d):
    return table(s, d, "documents").select("doc_id", txt.snippet(F.col("text")).alias("snippet"))


def _tokens(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(txt.tokens(F.col("text")), " ").alias("tokens"))


def _nested(s, d):
    out = sinks.nested(_search(s, d, scoring.Params(), 10), _queries(s, d))
    row = lambda x: F.concat_ws(":", x["rank"].cast("string"), x["doc_id"])
    return out.select("qid", F.size("results").cast("long").alias("n"), F.array_join(F.transform("results", row), ",").alias("results"))


def _grid(s, d, space=SPACE):
    return _kept(s, d, f"grid {space}", lambda: _rounded(grid.grid_search(_index(s, d), _queries(s, d), _qrels(s, d), space)).persist())


def _sample(s, d):
    return sampling.stratified(_docs(s, d), _qrels(s, d), SMALL_SAMPLE).select("doc_idx", "relevant")


def _worst(s, d):
    q = scoring.scores(_index(s, d), _terms(s, d), scoring.Params())
    return q.where("score < 0").select("q_idx", "doc_idx", (F.round("score", 6) + 0.0).alias("score"))


def _single(s, d):
    q = _queries(s, d).where("q_idx = 2").select("q_idx", "query")
    return _hits(scoring.search_many(_index(s, d), q, scoring.Params(), 10)).drop("q_idx")


P = scoring.Params

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tokenize_documents": _tokens,
    "term_counts_first_pos": lambda s, d: indexing.counted_terms(table(s, d, "documents").select(F.col("doc_id").alias("doc_idx"), txt.tokens(F.col("text")).alias("tokens")), ["doc_idx"]),
    "postings": lambda s, d: _index(s, d).postings,
    "doc_stats": lambda s, d: _rounded(_index(s, d).document_stats),
    "term_stats": lambda s, d: _index(s, d).terms,
    "corpus_stats": lambda s, d: _rounded(_index(s, d).corpus),
    "feat_length_distribution": _length,
    "feat_term_frequency": lambda s, d: _rounded(feat.frequency_features(_index(s, d)).drop(feat.ID)),
    "feat_vocabulary": lambda s, d: _rounded(feat.vocabulary_features(_index(s, d)).drop(feat.ID)),
    "feat_zipf": lambda s, d: _rounded(feat.zipf(_index(s, d)).drop(feat.ID)),
    "feat_heaps": lambda s, d: _rounded(feat.heaps(_index(s, d)).drop(feat.ID)),
    "feat_query_side": lambda s, d: _rounded(feat.query_features(_index(s, d), _terms(s, d)).drop(feat.ID)),
    "features_all": lambda s, d: _rounded(_features(s, d)),
    "features_by_source": lambda s, d: _rounded(_wide(s, d, "source").drop(*feat.QUERY_KEYS)),
    "features_by_lang": lambda s, d: _rounded(_wide(s, d, "lang").drop(*feat.QUERY_KEYS)),
    "idf_rsj": lambda s, d: _idf(s, d, "rsj"),
    "idf_smoothed": lambda s, d: _idf(s, d, "smoothed"),
    "bm25_default_top10": lambda s, d: _hits(_search(s, d, P(), 10)),
    "bm25_k3_top10": lambda s, d: _hits(_search(s, d, P(k3=4.0), 10)),
    "bm25_plus_top10": lambda s, d: _hits(_search(s, d, P(delta=1.0), 10)),
    "bm25_smoothed_top10": lambda s, d: _hits(_search(s, d, P(idf_type="smoothed"), 10)),
    "bm25_negative_scores": _worst,
    "bm25_single_query": _single,
    "score_doc_postings": lambda s, d: _rounded(scoring.score_documents(_index(s, d), "the", P(delta=0.5))),
    "bm25_adaptive_top100": lambda s, d: _hits(_search(s, d, _adaptive(s, d), 100)),
    "heuristic_params": lambda s, d: predict.heuristic(_features(s, d), []),
    "heuristic_params_by_source": lambda s, d: predict.heuristic(_wide(s, d, "source"), ["corpus_id"]),
    "dict_normaliser": lambda s, d: _rounded(_table(s, d).normaliser()),
    "dict_zscores": lambda s, d: _rounded(_table(s, d).zscores(_long(s, d)).select("corpus_id", "key", "z")),
    "dict_distances": lambda s, d: _rounded(_table(s, d).distances(_long(s, d))),
    "dict_ood_flags": lambda s, d: _table(s, d).out_of_range(_long(s, d)),
    "dict_lookup_k1": lambda s, d: _rounded(_table(s, d, match_threshold=1e9, reject_oov=False).lookup(_long(s, d)).drop("dict_distance")),
    "dict_lookup_k3": lambda s, d: _rounded(_table(s, d, k_neighbors=3, match_threshold=1e9, reject_oov=False).lookup(_long(s, d)).drop("dict_distance")),
    "dict_probe": lambda s, d: _rounded(_table(s, d).probe(_long(s, d))),
    "predict_with_dictionary": lambda s, d: _rounded(_table(s, d).predict(_targets(s, d)), 4),
    "qrels_derived": _qrels,
    "ideal_dcg": lambda s, d: _rounded(metrics.ideal(metrics.relevance(_qrels(s, d)))),
    "metrics_per_query": lambda s, d: _rounded(metrics.per_query(_search(s, d, P(), 100), _queries(s, d), _qrels(s, d))),
    "metrics_default": lambda s, d: _rounded(_evaluated(s, d, P())),
    "metrics_adaptive": lambda s, d: _rounded(_evaluated(s, d, _adaptive(s, d))),
    "metrics_improvement": lambda s, d: _rounded(metrics.improvement(_evaluated(s, d, P()), _evaluated(s, d, _adaptive(s, d))), 4),
    "results_nested": _nested,
    "grid_combos": lambda s, d: grid.combos(s, grid.Space()),
    "grid_search": lambda s, d: _grid(s, d, grid.Space()),  # too slow for SQL: the tests hold it against brute force
    "grid_search_best": lambda s, d: grid.best(_grid(s, d, grid.Space())),
    "grid_search_small": _grid,
    "grid_best": lambda s, d: grid.best(_grid(s, d)),
    "stratified_subsample": _sample,
    "subsample_qrels": lambda s, d: sampling.kept_qrels(_qrels(s, d), sampling.stratified(_docs(s, d), _qrels(s, d), SMALL_SAMPLE)),
    "snippets": _snippets,
}


def _idf(s: SparkSession, d: str, kind: str) -> DataFrame:
    ix = _index(s, d)
    return ix.terms.select("term", F.round(scoring.idf(F.lit(ix.doc_count), F.col("df"), kind), 6).alias("idf"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
