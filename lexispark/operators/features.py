"""The 21 corpus and query statistics, one row for each corpus.

Documents are read once and terms once for all statistics of their kind. Vocabulary ranks come from the histogram of
frequencies, with sums in closed form, and the vocabulary growth curve from at most fifty buckets of document
positions, so nothing sorts the vocabulary or the documents in one task, nor lists a rank for each term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.functions.stats import or_zero, pearson, ratio, skew_unbiased, slope, std_sample
from lexispark.operators.index import Index
from lexispark.staging import small

CORPUS_KEYS = (
    "avgdl", "std_len", "cv_len", "len_skew", "len_p90", "len_p10", "len_ratio_p90_p10", "avg_ttr", "avg_max_tf", "length_tf_corr",
    "hapax_ratio", "vocab_size", "zipf_alpha", "heaps_beta", "stopword_density",
)
QUERY_KEYS = ("avg_query_len", "avg_query_max_tf", "query_repeat_ratio", "query_oov_ratio", "query_idf_mean", "query_idf_std")
#: The order of the feature vector.
FEATURE_KEYS = (*CORPUS_KEYS, *QUERY_KEYS)

ID = "corpus_id"


def _keyed(df: DataFrame) -> DataFrame:
    return df if ID in df.columns else df.withColumn(ID, F.lit(0))


#: Corpora of one job whose scalars are broadcast; beyond that their joins shuffle.
MOST_CORPORA = 10_000


def _few(index: Index, scalars: DataFrame) -> DataFrame:
    """A broadcast hint for a table with one row for each corpus: a single one, or few after a count."""
    return small(scalars, MOST_CORPORA) if index.keys else F.broadcast(scalars)


def _length_columns() -> list[Column]:
    dl = F.col("dl").cast("double")
    mean, std = F.avg(dl), std_sample(dl)
    high, low = F.percentile(dl, F.lit(0.9)), F.percentile(dl, F.lit(0.1))  # a count for each distinct length
    return [
        F.count("*").alias("doc_count"), F.count("*").alias("num_docs"), F.sum("dl").cast("long").alias("total_tokens"), mean.alias("avgdl"), std.alias("std_len"),
        ratio(std, mean).alias("cv_len"), skew_unbiased(dl).alias("len_skew"), high.alias("len_p90"), low.alias("len_p10"),
        (high / F.greatest(low, F.lit(1.0))).alias("len_ratio_p90_p10"),
    ]


def _frequency_columns() -> list[Column]:
    return [
        F.avg("ttr").alias("avg_ttr"), F.avg("max_tf").alias("avg_max_tf"), pearson(F.col("dl").cast("double"), F.col("mean_tf")).alias("length_tf_corr"),
        ratio(F.sum("stop_tokens"), F.sum("dl")).alias("stopword_density"),
    ]


def length_features(index: Index) -> DataFrame:
    return _keyed(index.documents).groupBy(ID).agg(*_length_columns())


def frequency_features(index: Index) -> DataFrame:
    return _keyed(index.document_stats).groupBy(ID).agg(*_frequency_columns())


def document_features(index: Index) -> DataFrame:
    """What ``length_features`` and ``frequency_features`` give, from one pass over the documents."""
    return _keyed(index.document_stats).groupBy(ID).agg(*_length_columns(), *_frequency_columns())


def vocabulary_features(index: Index) -> DataFrame:
    return _keyed(index.terms).groupBy(ID).agg(F.avg((F.col("cf") == 1).cast("double")).alias("hapax_ratio"), F.count("*").alias("vocab_size"))


#: Ranks up to here are summed one by one, those beyond by the Euler-Maclaurin formula (error below 1e-12).
EXACT_RANKS = 1024


def _log_sums(low: Column, high: Column) -> tuple[Column, Column]:
    """Sums of ln(r) and of ln(r)^2 over the whole numbers from low to high, for low of some hundreds or more."""
    a, b = low.cast("double"), high.cast("double")
    la, lb = F.log(a), F.log(b)
    one = b * lb - b - (a * la - a) + (la + lb) / 2 + (1 / b - 1 / a) / 12
    two = (b * lb * lb - 2 * b * lb + 2 * b) - (a * la * la - 2 * a * la + 2 * a) + (la * la + lb * lb) / 2 + (2 * lb / b - 2 * la / a) / 12
    return one, two


def zipf(index: Index) -> DataFrame:
    """Slope of log frequency on log rank; the ranks of a frequency are one range of the histogram of frequencies."""
    hist = _keyed(index.terms).groupBy(ID, "cf").agg(F.count("*").alias("n"))
    last = F.sum("n").over(Window.partitionBy(ID).orderBy(F.col("cf").desc()).rowsBetween(Window.unboundedPreceding, 0))
    ranges = hist.withColumn("b", last).withColumn("a", F.col("b") - F.col("n") + 1)
    split = F.greatest(F.col("a"), F.least(F.col("b") + 1, F.lit(EXACT_RANKS + 1)))  # the first rank that is summed by the formula
    near = F.when(F.col("_split") > F.col("a"), F.sequence(F.col("a"), F.col("_split") - 1)).otherwise(F.array().cast("array<bigint>"))
    total = lambda f: F.aggregate("_near", F.lit(0.0), lambda s, r: s + f(F.log(r.cast("double"))))
    one, two = (F.when(F.col("_split") <= F.col("b"), x).otherwise(0.0) for x in _log_sums(F.col("_split"), F.col("b")))
    sums = ranges.withColumn("_split", split).withColumn("_near", near).select(ID, "cf", "n", (total(lambda x: x) + one).alias("x"), (total(lambda x: x * x) + two).alias("xx"))
    y = F.log(F.col("cf").cast("double"))
    each = sums.groupBy(ID).agg(F.sum("n").cast("double").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx"), F.sum(F.col("n") * y).alias("y"), F.sum(F.col("x") * y).alias("xy"))
    rise, run = F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.col("xx") - F.col("x") * F.col("x") / F.col("n")
    return each.select(ID, F.when(F.col("n") >= 2, F.abs(or_zero(F.try_divide(rise, run)))).otherwise(0.0).alias("zipf_alpha"))


def heaps(index: Index, points: int = 50) -> DataFrame:
    """Slope of log vocabulary on log tokens over at most ``points`` document positions; doc_idx is dense from 0."""
    docs, terms = _keyed(index.documents), _keyed(index.terms)
    n = F.col("_n").cast("double")
    spaced = F.expr(f"transform(sequence(0, {points - 1}), i -> cast(bround(pow(10D, i * log10(cast(_n as double)) / {max(1, points - 1)})) as long) - 1)")
    chosen = F.when(n > points, F.array_sort(F.array_distinct(F.transform(spaced, lambda p: F.greatest(F.lit(0).cast("long"), F.least(p, F.col("_n") - 1)))))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    at = docs.groupBy(ID).agg(F.count("*").alias("_n")).select(ID, chosen.alias("_at"))
    bucket = lambda c: F.size(F.filter("_at", lambda p: p < F.col(c))).alias("_b")
    at = _few(index, at)
    tokens = docs.join(at, ID).groupBy(ID, bucket("doc_idx")).agg(F.sum("dl").alias("tokens"), F.lit(0).cast("long").alias("words"))
    words = terms.join(at, ID).groupBy(ID, bucket("first_doc")).agg(F.lit(0).cast("long").alias("tokens"), F.count("*").alias("words"))
    both = tokens.unionByName(words).groupBy(ID, "_b").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
    grid = at.select(ID, F.posexplode("_at").alias("_b", "_pos")).join(both, [ID, "_b"], "left").fillna(0)
    upto = Window.partitionBy(ID).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    curve = grid.select(ID, F.sum("tokens").over(upto).alias("n"), F.sum("words").over(upto).alias("v")).where("n > 0")
    return curve.groupBy(ID).agg(F.when(F.count_distinct("n") >= 2, slope(F.log("v"), F.log("n"))).otherwise(0.0).alias("heaps_beta"))


def query_features(index: Index, query_term: DataFrame) -> DataFrame:
    """Statistics of the non-empty queries against each corpus; all 0 where no query has a token."""
    per = query_term.groupBy("q_idx").agg(F.sum("qtf").alias("len"), F.max("qtf").alias("max_tf"))
    shape = per.agg(
        F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_query_len"), F.coalesce(F.avg("max_tf"), F.lit(0.0)).alias("avg_query_max_tf"),
        F.coalesce(F.avg((F.col("max_tf") > 1).cast("double")), F.lit(0.0)).alias("query_repeat_ratio"),
    )
    # One row for each corpus and used term: the terms a corpus knows, and the uses of all terms to tell the others.
    used = small(query_term.groupBy("term").agg(F.sum("qtf").alias("uses")))
    uses = query_term.agg(F.coalesce(F.sum("qtf"), F.lit(0)).alias("all"))
    corpora = _keyed(index.corpus).select(ID, F.col("doc_count").alias("_n"))
    known = _keyed(index.terms).select(ID, "term", "df").join(used, "term").join(_few(index, corpora), ID)
    weight = F.log((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # Sums weighted by the uses of a term stand for one value for each token.
    rows = known.select(ID, "uses", weight.alias("w"))
    w, u = F.col("w"), F.col("uses")
    mean = rows.groupBy(ID).agg(F.sum("uses").alias("m"), F.sum(u * w).alias("s"))
    mean = mean.withColumn("_mean", ratio(F.col("s"), F.col("m")))
    spread = rows.join(_few(index, mean.select(ID, "_mean")), ID).groupBy(ID).agg(F.sum(u * F.pow(w - F.col("_mean"), 2)).alias("ss"))
    out = corpora.select(ID).join(mean, ID, "left").join(spread, ID, "left").join(F.broadcast(shape)).join(F.broadcast(uses))  # one row each
    m = F.coalesce("m", F.lit(0))
    return out.select(
        ID, "avg_query_len", "avg_query_max_tf", "query_repeat_ratio", ratio(F.col("all") - m, F.col("all")).alias("query_oov_ratio"),
        or_zero(F.col("_mean")).alias("query_idf_mean"),
        F.when(m > 1, F.sqrt(F.col("ss") / F.when(m > 1, m - 1))).otherwise(0.0).alias("query_idf_std"),
    )


def features(index: Index, query_term: DataFrame | None = None, heaps_points: int = 50) -> DataFrame:
    """All statistics; the query ones are null where there are no queries at all."""
    out = document_features(index)
    for part in (vocabulary_features(index), zipf(index), heaps(index, heaps_points)):
        out = out.join(part, ID, "left")
    zero = ["hapax_ratio", "zipf_alpha", "heaps_beta"]
    out = out.fillna(0.0, zero).withColumn("vocab_size", F.coalesce("vocab_size", F.lit(0)).cast("long"))
    if query_term is None:
        out = out.withColumns({k: F.lit(None).cast("double") for k in QUERY_KEYS})
    else:
        out = out.join(query_features(index, query_term), ID, "left")
    return out.select(*index.keys, "doc_count", "num_docs", "total_tokens", *FEATURE_KEYS)


def long_form(wide: DataFrame, name: str = ID) -> DataFrame:
    """(name, key, value) of the feature vector, absent keys left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in FEATURE_KEYS]))
    return wide.select(name, pairs.alias("p")).select(name, "p.key", "p.value").where("value is not null")
