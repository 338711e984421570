"""Token expressions: lower case, split at Unicode white space, nothing else."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: Unicode White_Space and U+001C to U+001F, as a class that Java and RE2 both read.
WHITE_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# Fixed value: words of the loaded English list that are not stop words here.
NOT_STOP_WORDS = ("don", "just", "now", "s", "t", "will")


def tokens(text: Column) -> Column:
    """The tokens of a text; stop words and punctuation stay."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE_SPACE), lambda x: x != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.transform(F.array(value), body)[0]


def counts(token_array: Column) -> Column:
    """Array of (term, tf) of one row's tokens, sorted by term: counting stays inside the row, so it needs no shuffle."""

    def counted(t):
        n = F.size(t)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        one = lambda s, i, j: F.struct(F.get(t, i).alias("term"), (F.coalesce(F.get(s, j + 1), n) - i).cast("long").alias("tf"))
        return let(starts, lambda s: F.transform(s, lambda i, j: one(s, i, j)))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return let(F.sort_array(token_array), lambda t: F.when(F.size(t) > 0, counted(t)).otherwise(none))


def stop_words(spark: SparkSession) -> list[str]:
    """The 175 English stop words, from the list that Spark ships."""
    loaded = spark._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")
    return sorted(set(loaded) - set(NOT_STOP_WORDS))


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """A stop list from a text file, one word a line."""
    return sorted({r[0].strip().lower() for r in spark.read.text(path).collect() if r[0].strip()})


def snippet(text: Column, size: int = 110) -> Column:
    """The first characters of a text with white space made single."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), lambda x: x != "")
    return F.substring(F.array_join(parts, " "), 1, size)


def truncated(token_array: Column, most: int) -> Column:
    return F.slice(token_array, 1, most)


def windows(token_array: Column, size: int, stride: int) -> Column:
    """Overlapping windows of tokens; the last may be shorter."""
    n = F.size(token_array)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(stride))
    return F.transform(starts, lambda i: F.slice(token_array, i, size))
