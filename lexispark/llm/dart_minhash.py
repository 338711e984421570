"""Near-duplicate documents by DartMinHash signatures of weighted word shingles.

A document is the weighted set of its five-word shingles, each weighted by how often it occurs (a document of
fewer words has one shingle: all of them). Hashed darts are thrown at the (shingle, weight, rank) space: a dart
hits a document if its shingle is there and its weight position lies below the shingle's weight. Each dart
belongs to one coordinate, and a coordinate keeps the hit of least rank, so two documents agree in a coordinate
with the probability of their weighted Jaccard similarity. Ranks are thrown only up to a bound that fits the
document's total weight, which takes time in proportion to its length plus ``k log k``.

Signatures are cut into bands. Documents that share a band are candidates; their texts are compared exactly and
linked where the weighted Jaccard similarity is 0.8 or more. Groups are the connected components of the links.

Exact copies (equal sequences of words) are one class and take part once, by their least doc_id. A bucket does
not compare all its pairs: each member meets the bucket's least member, then the one with the fewest shingles of its
own, and only members that are still outside the bucket's largest component meet the rest, unless a bound on what
the two can share (``unshared``) or the triangle inequality rules a link out.

Defined results: a null text or null doc_id is alone in its group and kept (``keep_one`` also removes repeats of rows
without an id); texts without a word are grouped only if they are equal; rows that share a doc_id are one document, of
which ``keep_one`` leaves one row; of equal ids the least stands for a group; an empty table gives an empty result; texts
are read whole; other columns, whatever their names, pass unread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import textvec as tv
from lexispark.llm.graph import components
from lexispark.llm.runtime import Stage, bounded_batches, fresh, small

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares one of 24 bands of 5 coordinates with probability 0.99993.
BANDS, ROWS = 24, 5
#: Buckets with more members than this are joined with their hub by broadcast: one task would get them all.
HOT_BUCKET = 1000
#: Members that one task compares with a copy of the hub's text.
MEMBERS_PER_HUB = 400

_U = np.uint64


def _thrown(seed: np.ndarray, width: float, bound: np.ndarray):
    """Darts of each column of the given width: (column, rank, hash), for ranks below the column's bound.

    The ranks of a column are the arrivals of a Poisson process, each gap drawn from the column's seed and the
    dart's number, so that a column has the same darts in whatever document it is.
    """
    active, rank, n = np.arange(len(seed)), np.zeros(len(seed)), 0
    while len(active):
        if n < 16:  # most columns end here
            n += 1
            h = tv.mix(seed[active] + _U((n * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            rank = rank - np.log(tv.uniform(h)) / width
            on = rank < bound[active]
            active, rank = active[on], rank[on]
            yield active, rank, h[on]
            continue
        left = float(((bound[active] - rank) * width).max())  # short documents: many darts for each shingle
        m = int(left + 8 * math.sqrt(left) + 16)
        rest_a, rest_r = [], []
        step = max(1, 2_000_000 // m)
        for i in range(0, len(active), step):
            a, r = active[i : i + step], rank[i : i + step]
            h = tv.mix(seed[a][:, None] + np.arange(n + 1, n + m + 1, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15))
            ranks = np.cumsum(np.concatenate([r[:, None], -np.log(tv.uniform(h)) / width], axis=1), axis=1)[:, 1:]
            on = ranks < bound[a][:, None]
            yield np.repeat(a, on.sum(1)), ranks[on], h[on]
            rest_a.append(a[on[:, -1]])
            rest_r.append(ranks[on[:, -1], -1])
        active, rank, n = np.concatenate(rest_a), np.concatenate(rest_r), n + m


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """The k-coordinate signature of each row's weighted set; rows without elements have zeros.

    ``element`` are 64-bit hashes, distinct within a row; weights are positive, and best of the order of 1.
    """
    out, filled = np.zeros(rows * k, dtype=_U), np.zeros(rows * k, dtype=bool)
    total = np.bincount(row, weights=weight, minlength=rows)
    todo, throws = total > 0, k * (math.log(k) + 3.0)
    while todo.any():
        on = todo[row]
        r, e, w = row[on], element[on], weight[on]
        bound = throws / total[r]
        at, ranks, ids = [], [], []
        level = 0
        while True:
            low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
            into = np.flatnonzero(w > low)
            if not len(into):
                break
            seed = tv.mix(e[into] ^ _U((level * 0xA24BAED4963EE407) & (2**64 - 1)))
            for col, rank, h in _thrown(seed, width, bound[into]):
                ident = tv.mix(h ^ _U(0x5851F42D4C957F2D))
                col = into[col]
                hit = (w[col] >= low + width) | (low + width * tv.uniform(tv.mix(ident ^ _U(0x14057B7EF767814F))) < w[col])
                at.append(r[col[hit]])
                ranks.append(rank[hit])
                ids.append(ident[hit])
            level += 1
        at, ranks, ids = np.concatenate(at), np.concatenate(ranks), np.concatenate(ids)
        slot = at * k + ((ids >> _U(20)) % _U(k)).astype(np.int64)
        order = np.argsort(ranks)[::-1]  # the least rank is written last
        out[slot[order]] = ids[order]
        filled[slot] = True
        todo &= ~filled.reshape(rows, k).all(1)
        throws *= 2
    return out.reshape(rows, k)


def bands(signature: np.ndarray, count: int = BANDS, size: int = ROWS) -> np.ndarray:
    """A hash of each band of each signature, different for different bands."""
    out = np.broadcast_to(np.arange(1, count + 1, dtype=_U), (len(signature), count)).copy()
    for j in range(size):
        out = tv.mix(out * _U(0xD6E8FEB86659FD93) + signature[:, j : count * size : size])
    return out


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """(row, shingle, count), sorted, of the texts of a chunk; and the words' hashes and rows."""
    word, row = tv.words(data, offsets)
    sh, sh_row = tv.shingles(word, row, size)
    return tv.counted(sh_row, sh), word, row


def _signed(batches):
    for batch in batches:
        text, doc_id = batch.column("text"), batch.column("doc_id")
        for first, last, data, offsets in tv.chunks(text):
            rows = last - first
            (row, sh, count), word, word_row = weighted_shingles(data, offsets)
            sig = signatures(row, sh, count.astype(float), rows, BANDS * ROWS)
            total = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
            d1, d2 = (tv.row_digest(word, word_row, rows, s) for s in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))
            bare = total == 0  # no word: known by all its bytes
            d1[bare] = tv.span_hashes(data, offsets[:-1], offsets[1:])[bare]
            d2[bare] = 0
            null = text.slice(first, rows).is_null().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(np.where(bare, 0, BANDS))]).astype(np.int32)
            flat = pa.array(bands(sig[~bare]).ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [doc_id.slice(first, rows).cast(pa.int64()), pa.array(d1.view(np.int64), mask=null), pa.array(d2.view(np.int64), mask=null), pa.array(total), pa.ListArray.from_arrays(pa.array(ends), flat)],
                ["doc_id", "d1", "d2", "n", "bands"],
            )


def _compare(batches, threshold: float):
    """Links of a stream sorted by (hub, part, side): the hub's text first, then its members' texts."""
    hub, held, weight = None, None, 0
    for batch in batches:
        b, side, a = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "side", "a"))
        left, right, found = [], [], []
        for first, last, data, offsets in tv.chunks(batch.column("text")):
            (row, sh, count), _, _ = weighted_shingles(data, offsets)
            at = np.searchsorted(row, np.arange(last - first + 1))
            for i in range(last - first):
                s, c = sh[at[i] : at[i + 1]], count[at[i] : at[i + 1]]
                if side[first + i] == 0:
                    hub, held, weight = b[first + i], (s, c), int(c.sum())
                elif hub == b[first + i] and len(s) and len(held[0]):
                    pos = np.minimum(np.searchsorted(held[0], s), len(held[0]) - 1)
                    same = held[0][pos] == s
                    both = int(np.minimum(c[same], held[1][pos[same]]).sum())
                    union = weight + int(c.sum()) - both
                    if both >= threshold * union - 1e-9:
                        left.append(a[first + i])
                        right.append(hub)
                        found.append(both / union)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def verified(docs: DataFrame, pairs: DataFrame, stage: Stage, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose texts are at least ``threshold`` similar, with the similarity.

    Each text travels once for each of its pairs as member ``a``; a hub ``b`` of many members is dealt out in
    parts, each with a copy of the hub's text.
    """
    pairs = stage.table(pairs)
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(MEMBERS_PER_HUB)).cast("int").alias("parts"))
    parts = stage.table(hubs)
    dealt = stage.table(pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")))
    copies = stage.table(parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where("_id is not null and text is not null")
    members = texts.join(small(dealt), F.col("_id") == F.col("a")).select("b", "part", F.lit(1).alias("side"), "a", "text")
    heads = texts.join(small(copies), F.col("_id") == F.col("b")).select("b", "part", F.lit(0).alias("side"), F.col("b").alias("a"), "text")
    stream = members.unionByName(heads).repartition("b", "part").sortWithinPartitions("b", "part", "side", "a")
    bounded_batches(docs.sparkSession)
    return stage.table(stream.mapInArrow(lambda x: _compare(x, threshold), "a long, b long, similarity double"))


def _elements(batches):
    for batch in batches:
        for first, last, data, offsets in tv.chunks(batch.column("text")):
            (row, sh, count), _, _ = weighted_shingles(data, offsets)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, last - first).take(pa.array(row)) for c in ("rep", "label")], pa.array(sh.view(np.int64)), pa.array(count)], ["rep", "label", "shingle", "weight"])


def unshared(docs: DataFrame, ids: DataFrame, repeated: DataFrame, stage: Stage) -> DataFrame:
    """(rep, own): the weight of each document's shingles that no document of another label has.

    ``ids`` has rep and label; ``repeated`` has the rep of each doc_id of several rows and whether their words
    differ. Equal rows count once; rows that differ have no weight of their own, so no bound rules them out. Two documents of different labels and weights n and m share at most
    s = min(n - own, m - own) of them, so their similarity is at most s / (n + m - s): a bound that spares most
    comparisons of copies that were each changed on their own, and of groups that resemble each other.
    """
    bounded_batches(docs.sparkSession)
    ids = stage.table(ids)
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep is not null and text is not null").join(small(ids), "rep")
    if not repeated.isEmpty():
        texts = texts.join(small(repeated), "rep", "left")
        once = texts.where("not differ").dropDuplicates(["rep"])
        texts = texts.where("differ is null or differ").unionByName(once).drop("differ")
    elements = stage.table(texts.mapInArrow(_elements, "rep long, label long, shingle long, weight long"))
    exclusive = elements.groupBy("shingle").agg(F.min("label").alias("label"), F.max("label").alias("last"), F.count("*").alias("holders"), F.min("rep").alias("rep"), F.sum("weight").alias("weight")).where("label = last")
    exclusive = stage.table(exclusive)
    alone = exclusive.where("holders = 1").select("rep", "weight")
    among = elements.join(exclusive.where("holders > 1").select("shingle"), "shingle", "left_semi").select("rep", "weight")
    own = alone.unionByName(among).groupBy("rep").agg(F.sum("weight").alias("own"))
    out = stage.table(own.join(small(repeated.where("differ").select("rep")), "rep", "left_anti"))
    stage.drop(elements, exclusive)
    return out


def by_bucket(rows: DataFrame, buckets: DataFrame, stage: Stage, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row for each bucket, which has the bucket's ``size``.

    A few buckets are broadcast. Else the large ones are, of which there are at most rows / HOT_BUCKET, so that no task
    gets all members of one, and the others are shuffled.
    """
    buckets = stage.table(buckets)
    few = small(buckets)
    if few is not buckets:
        return rows.join(few.drop("size"), "bucket", how)
    hot = small(buckets.where(F.col("size") > HOT_BUCKET).drop("size"))
    rest = rows.join(hot.select("bucket"), "bucket", "left_anti")
    return rows.join(hot, "bucket", how).unionByName(rest.join(buckets.where(F.col("size") <= HOT_BUCKET).drop("size"), "bucket", how))


def _alike(x, y):
    """Whether the weights allow a similarity of 0.8."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(THRESHOLD)


def _signed_table(docs: DataFrame, stage: Stage) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return stage.table(docs.select("doc_id", "text").mapInArrow(_signed, "doc_id long, d1 long, d2 long, n long, bands array<long>"))


def _classes(signed: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The classes of exact copies, and the doc_ids of several rows with whether their words differ."""
    named = signed.where("d1 is not null and doc_id is not null")
    classes = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    ways = F.struct("d1", "d2")
    repeated = named.groupBy(F.col("doc_id").alias("rep")).agg((F.min(ways) != F.max(ways)).alias("differ"), F.count("*").alias("rows"))
    return stage.table(classes), stage.table(repeated.where("rows > 1").drop("rows"))


def _members(classes: DataFrame, stage: Stage) -> DataFrame:
    """The members of each bucket of several classes, with the least one as the bucket's hub."""
    banded = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    return stage.table(by_bucket(banded, shared, stage).select("bucket", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")))


def _open(docs: DataFrame, members: DataFrame, links: DataFrame, repeated: DataFrame, stage: Stage) -> DataFrame:
    """The members of buckets whose links so far lead elsewhere than the hub, with the weight they may share (``most``);
    without those whose own shingles rule out any link."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    label = stage.table(low.join(low.select(F.col("a").alias("low"), F.col("low").alias("lower")), "low", "left").select(F.col("a").alias("rep"), F.coalesce("lower", "low").alias("label")))
    labelled = members.join(small(label), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = stage.table(labelled.join(small(label).select(F.col("rep").alias("hub"), F.col("label").alias("hub_label")), "hub", "left").withColumn("hub_label", F.coalesce("hub_label", "hub")))
    open_buckets = labelled.groupBy("bucket").agg(F.count("*").alias("size"), F.max(F.col("label") != F.col("hub_label")).alias("open")).where("open").drop("open")
    labelled = stage.table(by_bucket(labelled, open_buckets, stage))
    own = unshared(docs, labelled.select("rep", F.col("rep").alias("label")).distinct(), repeated, stage)
    most = F.col("n") - F.coalesce("own", F.lit(0))
    return stage.table(labelled.join(small(own), "rep", "left").withColumn("most", most).where(F.col("most") >= F.lit(THRESHOLD) * F.col("n")))


def _meet_originals(docs: DataFrame, labelled: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The open members with their bucket's likeliest original, the one with the fewest shingles of its own, and the
    similarity of all of them to it."""
    original = labelled.groupBy("bucket").agg(F.min_by("rep", F.struct(1 - F.col("most") / F.col("n"), "rep")).alias("original"), F.count("*").alias("size"))
    labelled = stage.table(by_bucket(labelled, original, stage))
    pair = [F.greatest("rep", "original").alias("a"), F.least("rep", "original").alias("b")]
    met = verified(docs, labelled.where("rep != original").select(*pair).distinct(), stage, 0.0)
    far = small(met).select("a", "b", (1 - F.col("similarity")).alias("far"))
    labelled = labelled.drop("label", "hub_label").select("*", *pair).join(far, ["a", "b"], "left").drop("a", "b").withColumn("far", F.coalesce("far", F.lit(0.0)))
    return labelled, met


def _remaining(docs: DataFrame, labelled: DataFrame, links: DataFrame, classes: DataFrame, repeated: DataFrame, stage: Stage) -> DataFrame:
    """Pairs (a, b) of different components that may still be linked.

    Who is outside its bucket's largest component meets the rest, where two bounds allow a link: what both can share, and
    the triangle inequality of Jaccard distances to the original; only in the first bucket of a pair.
    """
    group = small(components(links.select("a", "b"), stage))
    labelled = labelled.join(group.select(F.col("node").alias("rep"), F.col("component").alias("label")), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = stage.table(labelled)
    largest = labelled.groupBy("bucket", "label").agg(F.count("*").alias("size")).groupBy("bucket").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("labels"))
    labelled = stage.table(by_bucket(labelled, largest.where("labels > 1").drop("labels"), stage))
    own = unshared(docs, labelled.select("rep", "label").distinct(), repeated, stage)
    most = F.col("n") - F.coalesce("own", F.lit(0))
    labelled = stage.table(labelled.drop("own", "most").join(small(own), "rep", "left").withColumn("most", most).where(F.col("most") >= F.lit(THRESHOLD) * F.col("n")))
    labelled = stage.table(labelled.join(classes.select("rep", "bands"), "rep"))
    apart = labelled.where("label != main").select("bucket", *[F.col(c).alias(f"x_{c}") for c in ("rep", "n", "most", "label", "far", "bands")])
    most = F.least("most", "x_most")
    may = (most >= F.lit(THRESHOLD) * (F.col("n") + F.col("x_n") - most)) & (F.abs(F.col("far") - F.col("x_far")) <= F.lit(1 - THRESHOLD + 1e-9))
    return (
        apart.join(labelled.where("rep != original").select("bucket", "rep", "n", "most", "label", "far", "bands"), "bucket")
        .where((F.col("label") != F.col("x_label")) & may & (F.array_min(F.array_intersect("bands", "x_bands")) == F.col("bucket")))
        .select(F.greatest("x_rep", "rep").alias("a"), F.least("x_rep", "rep").alias("b")).distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (least id of its exact copies), group_id (least id of its
    group of near copies) and kept (doc_id = group_id)."""
    stage = Stage(docs.sparkSession, "dart-minhash")
    signed = _signed_table(docs, stage)
    classes, repeated = _classes(signed, stage)
    members = _members(classes, stage)
    hubs = members.where((F.col("rep") != F.col("hub")) & _alike(F.col("n"), F.col("hub_n"))).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    hubs = stage.table(hubs)
    links = verified(docs, hubs, stage)
    labelled = _open(docs, members, links, repeated, stage)
    labelled, met = _meet_originals(docs, labelled, stage)
    links = stage.table(links.unionByName(met.where(F.col("similarity") >= THRESHOLD)))
    rest = _remaining(docs, labelled, links, classes, repeated, stage).join(small(hubs), ["a", "b"], "left_anti")
    links = links.unionByName(verified(docs, rest, stage))
    group = small(components(links.select("a", "b"), stage))
    named = classes.join(group, F.col("rep") == F.col("node"), "left").select("d1", "d2", "rep", "copies", F.coalesce("component", "rep").alias("group_id"))
    named = stage.table(named.where("copies > 1 or group_id != rep"))
    out = signed.select("doc_id", "d1", "d2").join(small(named), ["d1", "d2"], "left").select(
        "doc_id",
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("group_id", "doc_id").alias("group_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("group_id", "doc_id"), F.lit(True)).alias("kept"),
    )
    return stage.result(out, signed, named)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without the later members of each group.

    Of rows that share a doc_id the one with the least hash of its text stays; a row without an id goes if a row with one
    has the same text (null and null are the same here), and of several without one that have the same text one stays.
    """
    stage = Stage(docs.sparkSession, "dart-minhash-kept")
    ident, whole, digest = fresh("ident", "whole", "digest")
    gone = stage.table(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(ident)).distinct())
    kept = docs.join(small(gone), F.col("doc_id").cast("long") == F.col(ident), "left_anti")
    twice = stage.table(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(ident)).agg(F.count("*").alias(whole)).where(F.col(whole) > 1).select(ident))
    nameless = stage.table(docs.where("doc_id is null").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias(digest), F.col("text").isNull().alias(ident)).agg(F.first(F.struct(*docs.columns)).alias(whole)))
    if twice.isEmpty() and nameless.isEmpty():
        return stage.result(kept, gone)
    same = F.col("doc_id") == F.col(ident)
    once = kept.where("doc_id is not null").join(small(twice), same, "left_anti")
    repeats = kept.join(small(twice), same, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias(whole)).select(f"{whole}.*")
    texts = docs.where("doc_id is not null").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias(digest), F.col("text").isNull().alias(ident))
    known = texts.join(small(nameless.select(digest, ident)), [digest, ident], "left_semi").distinct()
    alone = nameless.join(known, [digest, ident], "left_anti").select(f"{whole}.*")
    return stage.result(once.unionByName(repeats).unionByName(alone), gone, twice, nameless)


#: DuckDB's form of ``near_duplicates``: all pairs that share a shingle, compared exactly, and the closure of their links.
SQL = r"""
with recursive worded as (
  select doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
),
usable as (select * from worded where doc_id is not null and text is not null),
shingle as (
  select doc_id, sh, count(*) as c from (
    select doc_id, list_slice(w, s, s + 4) as sh from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as s from usable where len(w) > 0)
  ) group by all
),
total as (select doc_id, sum(c) as n from shingle group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, sum(least(a.c, b.c)) as common from shingle a join shingle b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
near as (select a, b from shared join total x on x.doc_id = a join total y on y.doc_id = b where 10 * common >= 8 * (x.n + y.n - common)),
equal as (select x.doc_id as a, y.doc_id as b from usable x join usable y on x.text = y.text and x.doc_id < y.doc_id where len(x.w) = 0),
link as (select a, b from near union select b, a from near union select a, b from equal union select b, a from equal),
reach(id, other) as (select doc_id, doc_id from usable union select reach.id, link.b from reach join link on link.a = reach.other),
least as (select id, min(other) as group_id from reach group by id),
class as (select min(doc_id) as class_id, w, case when len(w) = 0 then text end as t from usable group by all)
select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, coalesce(group_id, d.doc_id) as group_id, coalesce(d.doc_id = coalesce(group_id, d.doc_id), true) as kept
from worded d left join class c on c.w = d.w and c.t is not distinct from case when len(d.w) = 0 then d.text end and d.doc_id is not null left join least on least.id = d.doc_id
"""
