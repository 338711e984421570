"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is ten consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. Every window keeps the least hash of its
k-grams, in the benchmark as in the documents, so that a window that occurs in both has the same fingerprint in
both: no shared window is missed. Fingerprints that meet are extended over the words around them, and whole windows are
compared by a 64-bit hash of their words' 64-bit hashes (two different windows agree with a chance of some 2^-63).

Neighbouring windows with the same least hash form one row (fingerprint, position, word hashes), about two for
every seven words. The benchmark's distinct fingerprints are broadcast after a count shows them to be few; beyond
that bound the same join shuffles. Only rows whose fingerprint occurs in the benchmark go on.

Defined results: null, empty or word-free texts have no words and are not contaminated; items without words
match nothing; benchmark rows with a null item_id mark words but are not listed; rows that repeat, or share a
doc_id, get a result each; an empty benchmark marks nothing; other columns pass unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.llm.runtime import Stage, fresh, small

WINDOW = 10
GRAM = 5
#: Distinct fingerprints of a benchmark (16 bytes each) that may be broadcast.
BROADCAST_FINGERPRINTS = 1_000_000
# Fixed value: what separates words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text (ASCII texts take the faster way to lower case)."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.filter(F.split(low, SEPARATOR), lambda x: x != "")


def word_count(text: Column) -> Column:
    """The number of ``words``: capitals count as letters here, so no lower case is needed."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != "")).cast("long")


def fingerprints(hashes: Column, length: int) -> Column:
    """Rows (size, print, at, around) of the windows of ``length`` words.

    ``around`` has the hashes of the words of all neighbouring windows that share the fingerprint; ``at`` is the
    first one's position.
    """
    k = min(GRAM, length)
    span = length - k + 1

    def grouped(h, least):
        last = F.size(least)
        starts = F.filter(F.sequence(F.lit(0), last - 1), lambda s: (s == 0) | (F.get(least, s) != F.get(least, s - 1)))
        return let(
            starts,
            lambda starts: F.transform(
                starts,
                lambda s, j: F.struct(
                    F.lit(length).alias("size"),
                    F.get(least, s).alias("print"),
                    s.alias("at"),
                    F.slice(h, s + 1, F.coalesce(F.get(starts, j + 1), last) - s + (length - 1)).alias("around"),
                ),
            ),
        )

    def prints(h):
        n = F.size(h)
        grams = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(h, i, k)))
        if span == 1:
            return let(grams, lambda g: grouped(h, g))
        least = lambda g: F.transform(F.sequence(F.lit(1), n - (length - 1)), lambda i: F.array_min(F.slice(g, i, span)))
        return let(grams, lambda g: let(least(g), lambda m: grouped(h, m)))

    none = "array<struct<size:int,print:bigint,at:int,around:array<bigint>>>"
    return F.when(F.size(hashes) >= length, prints(hashes)).otherwise(F.array().cast(none))


def _printed(df: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """One row for each fingerprint of the rows' ``_text``, for each window length."""
    hashes = F.transform(words(F.col("_text")), lambda w: F.xxhash64(w))
    rows = let(hashes, lambda h: F.concat(*[fingerprints(h, n) for n in lengths]) if len(lengths) > 1 else fingerprints(h, lengths[0]))
    return df.select(*keys, F.inline(rows))


def _windows(printed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size, at, whole): every window of the fingerprints' rows, with the hash of its words."""
    span = F.expr("sequence(0, size(around) - size)")
    whole = F.transform(span, lambda i: F.struct((F.col("at") + i).alias("at"), F.xxhash64(F.slice("around", i + 1, F.col("size"))).alias("whole")))
    return printed.select(*keys, "size", F.inline(whole))


def hits(docs: DataFrame, items: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame] | None:
    """Windows of documents that occur in items, and the items' windows; None where no item has a word.

    ``docs`` has the keys ``_id, _h`` and ``_text``, ``items`` has ``item_id`` and ``_text``.
    """
    sized = items.select("item_id", "_text", F.least(word_count(F.col("_text")), F.lit(WINDOW)).cast("int").alias("_n")).where("_n > 0")
    lengths = sorted(r[0] for r in sized.select("_n").distinct().collect())  # at most ten numbers
    if not lengths:
        return None
    printed = None
    for n in lengths:
        part = _printed(sized.where(F.col("_n") == n), ["item_id"], [n])
        printed = part if printed is None else printed.unionByName(part)
    printed = stage.table(printed.select("item_id", "size", "print", "at", "around"))
    item_windows = stage.table(_windows(printed, ["item_id"]).select("item_id", "size", "whole").distinct())
    known = stage.table(printed.select("size", "print").distinct())
    wholes = stage.table(item_windows.select("size", "whole").distinct())
    met = _printed(docs, ["_id", "_h"], lengths).join(small(known, BROADCAST_FINGERPRINTS), ["size", "print"], "left_semi")
    found = _windows(met, ["_id", "_h"]).join(small(wholes, BROADCAST_FINGERPRINTS), ["size", "whole"], "left_semi")
    return stage.table(found.select("_id", "_h", "size", "at", "whole").distinct()), item_windows


def _keyed(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("_id"), F.xxhash64("text").alias("_h"), F.col("text").alias("_text"))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.col("text").alias("_text"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: words, words inside an occurring window, and the items that occur."""
    spark = docs.sparkSession
    stage = Stage(spark, "winnowing")
    keyed = _keyed(docs, "doc_id")
    counted = keyed.select("_id", "_h", word_count(F.col("_text")).alias("n_words"))
    got = hits(keyed, _items(benchmark), stage)
    digest = lambda ids: F.sha2(F.array_join(F.array_sort(ids), ","), 256)
    if got is None:
        out = counted.select(F.col("_id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
        return stage.result(out)
    found, item_windows = got
    end = F.col("at") + F.col("size")
    before = Window.partitionBy("_id", "_h").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        found.select("_id", "_h", "at", "size").distinct()
        .withColumn("_new", F.greatest(F.lit(0), end - F.greatest(F.col("at"), F.coalesce(F.max(end).over(before), F.col("at")))))
        .groupBy("_id", "_h").agg(F.sum("_new").alias("n_hit"))
    )
    # Windows of the same items are one: a passage that many items share meets them once, not once for each window.
    holders = item_windows.where("item_id is not null").groupBy("size", "whole").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    holders = stage.table(holders.withColumn("_set", F.md5(F.array_join("_items", ","))))
    sets = stage.table(holders.groupBy("_set").agg(F.first("_items").alias("_items")))
    listed = (
        found.select("_id", "_h", "size", "whole").distinct()
        .join(small(holders.select("size", "whole", "_set"), BROADCAST_FINGERPRINTS), ["size", "whole"])
        .select("_id", "_h", "_set").distinct().join(sets, "_set")
        .select("_id", "_h", F.explode("_items").alias("_item")).distinct()
        .groupBy("_id", "_h").agg(F.count("*").alias("n_items"), digest(F.collect_list("_item")).alias("items_sha256"))
    )
    c, x, y = counted.alias("c"), covered.alias("x"), listed.alias("y")
    same = lambda o: F.expr(f"c._id <=> {o}._id and c._h = {o}._h")
    out = c.join(x, same("x"), "left").join(y, same("y"), "left").select(
        F.col("c._id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
    return stage.result(out, found, holders, sets)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that share no window with the benchmark."""
    stage = Stage(docs.sparkSession, "winnowing")
    got = hits(_keyed(docs, "doc_id"), _items(benchmark), stage)
    if got is None:
        return docs
    ident, digest = fresh("ident", "digest")
    bad = stage.table(got[0].select(F.col("_id").alias(ident), F.col("_h").alias(digest)).distinct())
    out = docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col(ident)) & (F.xxhash64("text") == F.col(digest)), "left_anti")
    return stage.result(out, bad)


#: DuckDB's form of ``contamination``: every window is spelled out and joined.
SQL = r"""
with lowered as (
  select 'd' as side, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all
  select 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
),
worded as (select side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lowered),
item_size as (select id, w, least(len(w), 10) as n from worded where side = 'b' and len(w) > 0),
item_window as (select distinct id, n, list_slice(w, s, s + n - 1) as g from (select id, w, n, unnest(range(1, len(w) - n + 2)) as s from item_size)),
doc_window as (
  select id, n, s, list_slice(w, s, s + n - 1) as g
  from (select id, w, n, unnest(range(1, len(w) - n + 2)) as s from worded cross join (select distinct n from item_size) where side = 'd' and len(w) >= n)
),
hit as (select d.id, d.n, d.s, b.id as item from doc_window d join item_window b on d.n = b.n and d.g = b.g),
n_hit as (select id, count(distinct p) as n_hit from (select id, unnest(range(s, s + n)) as p from hit) group by id),
listed as (select id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct id, item::varchar as item from hit) group by id)
select w.id as doc_id, len(w.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
from worded w left join n_hit using (id) left join listed using (id)
where w.side = 'd'
"""
