"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its hashed terms: words and their first four and six bytes (so that inflected forms
share a term). The score is ``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)`` over the terms present; the pair
part learns what single weights cannot, such as an insult that matters only beside a mention of a group.

Terms enter the model by what they gain under it, not by what they do alone: first those that an additive model gains
by, then those of the pairs that still gain once the additive model is fitted (score tests of the pair weights on its
residuals). So a term without any effect of its own is kept if a pair with it has one.

Defined results: a null, empty or word-free text, or one without a known term, has the prior share of label 1 at most,
so a low score; repeated rows get equal scores, and a document of several rows is learned from once; several labels of
one document count as 1 if one is 1; a null doc_id is not held out and not learned from; an empty table gives an empty
result; columns other than the id and the text, whatever their names, pass unread. Texts are read whole. Terms never
seen in training add nothing. With labels of one class only (or none) nothing can be learned, and every score is the
prior share of label 1, 0.49 at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import textvec as tv
from lexispark.llm.runtime import bounded_batches

#: Hashed term space.
BITS = 24
#: Labelled rows that training may read for each class: a bound on a sample of labelled rows, chosen by a hash of the id.
ROWS_PER_CLASS = 4000
#: Factors of each term.
FACTORS = 8
#: Terms that may enter the model are in at least so many sampled texts; of these it keeps at most so many.
MIN_TEXTS, MAX_TERMS = 3, 1 << 14
#: Most frequent terms of the sample whose pairs are tested (every pair of them).
PAIR_TERMS = 4096
#: Terms that are columns of one dense block while pairs are tested: bounds the driver's memory.
BLOCK = 256
#: Weight of a piece of a text of label 0, as an example of its own, against the text's.
PIECE_COST = 1.0
#: Least score statistic of a single term and of a pair (some eight million pairs are tested).
MIN_Z, MIN_PAIR_Z = 3.5, 6.5


@dataclass
class FactorizationMachine:
    """``terms`` are sorted hashed ids; ``weight`` and ``factor`` are theirs by position."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    nothing: float  # the log odds of a text without a known term

    def score(self, row: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
        """Probabilities from (row, position of a term) pairs, each pair once."""
        z = np.full(rows, self.bias)
        z += np.bincount(row, weights=self.weight[at], minlength=rows)
        for k in range(self.factor.shape[1]):
            v = self.factor[at, k]
            z += 0.5 * (np.bincount(row, weights=v, minlength=rows) ** 2 - np.bincount(row, weights=v * v, minlength=rows))
        z[np.bincount(row, minlength=rows) == 0] = self.nothing
        return _probability(z)

    def find(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (row, position) pairs of the terms that the model knows."""
        if not len(self.terms) or not len(term):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        hit = self.terms[at] == term
        pair = np.unique(row[hit] * np.int64(len(self.terms)) + at[hit])
        return pair // len(self.terms), pair % len(self.terms)


def hashed_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed term) of each word and of each word's first four and six bytes; not yet distinct."""
    s, e, row = tv.word_spans(data, offsets)
    prefix = tv.byte_prefix(data)
    ids, rows = [tv.span_hashes(data, s, e, prefix)], [row]
    for k, n in enumerate((4, 6), 1):
        long = e - s > n
        ids.append(tv.span_hashes(data, s[long], s[long] + n, prefix) ^ np.uint64(k * 0xABCDEF0123))
        rows.append(row[long])
    return np.concatenate(rows), (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int64)


def _probability(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class _Sample:
    """Texts as sorted lists of term positions: those of text i are ``at[start[i] : start[i + 1]]``."""

    y: np.ndarray
    cost: np.ndarray  # each class has half of the weight
    at: np.ndarray
    start: np.ndarray

    def with_pieces(self, seed: int) -> _Sample:
        """The same texts, and of each text of label 0 a piece of up to three of its terms, which is of label 0 too, so
        that a short text of ordinary words is not toxic."""
        rng, clean, base = np.random.default_rng(seed), np.flatnonzero((self.y == 0) & (np.diff(self.start) > 0)), self.at.max(initial=0) + 1
        size = np.diff(self.start)[clean]
        row = np.repeat(np.arange(len(clean)), np.minimum(size, rng.integers(1, 4, len(clean))))
        piece = self.at[self.start[clean[row]] + (rng.random(len(row)) * size[row]).astype(np.int64)].astype(np.int64)
        pair = np.unique(row * base + piece)  # a term once
        ends = np.searchsorted(pair // base, np.arange(1, len(clean) + 1))
        return _Sample(np.append(self.y, np.zeros(len(clean))), np.append(self.cost, PIECE_COST * self.cost[clean]), np.append(self.at, pair % base), np.append(self.start, self.start[-1] + ends))

    def only(self, keep: np.ndarray, terms: int) -> _Sample:
        """The same texts with the terms ``keep`` alone, numbered anew."""
        new = np.full(terms, -1, np.int32)
        new[keep] = np.arange(len(keep))
        row, at = np.repeat(np.arange(len(self.y), dtype=np.int32), np.diff(self.start)), new[self.at]
        return _Sample(self.y, self.cost, at[at >= 0], np.searchsorted(row[at >= 0], np.arange(len(self.y) + 1)))


def _descend(s: _Sample, terms: int, factors: int, steps: int, seed: int, low: float) -> tuple[float, np.ndarray]:
    """Bias, and weight and factors of each term: AdaGrad on mini-batches. The bias stays at ``low`` or below, so that a
    text is toxic only by what is in it."""
    n, rng = len(s.y), np.random.default_rng(seed)
    p = np.concatenate([np.zeros((terms, 1)), rng.normal(0, 0.05, (terms, factors))], axis=1)  # weight, then factors
    g2, b, b2 = np.full_like(p, 1e-6), min(low, 0.0), 1e-6
    rate, ridge = 0.15, np.array([1e-4] + [1e-3] * factors)
    batches = max(1, n // 128)
    for _ in range(-(-steps // batches)):
        for batch in np.array_split(rng.permutation(n), batches):
            size = s.start[batch + 1] - s.start[batch]
            r = np.repeat(np.arange(len(batch)), size)
            cols = s.at[np.repeat(s.start[batch] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            x = p[cols]
            total = np.stack([np.bincount(r, weights=x[:, k], minlength=len(batch)) for k in range(factors + 1)], 1)
            square = np.bincount(r, weights=(x[:, 1:] ** 2).sum(1), minlength=len(batch))
            err = s.cost[batch] * (_probability(b + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - square)) - s.y[batch])
            grad = np.empty_like(x)
            grad[:, 0] = err[r]
            grad[:, 1:] = err[r][:, None] * (total[r, 1:] - x[:, 1:])
            used, back = np.unique(cols, return_inverse=True)
            if len(used):
                step = np.stack([np.bincount(back, weights=grad[:, k]) for k in range(factors + 1)], 1) / len(batch) + ridge * p[used]
                g2[used] += step**2
                p[used] -= rate * step / np.sqrt(g2[used])
            b2 += err.mean() ** 2
            b = min(low, b - rate * err.mean() / np.sqrt(b2))
    return float(b), p


def _pair_gains(s: _Sample, terms: np.ndarray, all_terms: int, p: np.ndarray) -> np.ndarray:
    """For each of ``terms`` the largest score statistic of its pairs, given each text's probability so far."""
    part, m, n = s.only(terms, all_terms), len(terms), len(s.y)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(part.start))

    def block(i: int) -> np.ndarray:
        on = (part.at >= i) & (part.at < i + BLOCK)
        x = np.zeros((n, min(BLOCK, m - i)), np.float32)
        x[row[on], part.at[on] - i] = 1
        return x

    one, zero = s.cost[s.y > 0][0], s.cost[s.y == 0][0]
    share = p * zero / (p * zero + (1 - p) * one)  # the probability of label 1 without the classes' weights
    info = np.maximum(share * (1 - share), 1e-3) * (one * (1 - p) + zero * p) ** 2  # the variance of an error
    err, info = (s.cost * (s.y - p)).astype(np.float32), info.astype(np.float32)
    best = np.zeros(m)
    for i in range(0, m, BLOCK):
        left = block(i)
        for j in range(i, m, BLOCK):
            right = left if i == j else block(j)
            both = left.T @ right
            z = np.abs(left.T @ (right * err[:, None])) / np.sqrt(left.T @ (right * info[:, None]) + 1e-6)
            z[both < MIN_TEXTS] = 0
            if i == j:
                np.fill_diagonal(z, 0)
            best[i : i + BLOCK] = np.maximum(best[i : i + BLOCK], z.max(axis=1))
            best[j : j + BLOCK] = np.maximum(best[j : j + BLOCK], z.max(axis=0))
    return best


def fit(y: np.ndarray, row: np.ndarray, term: np.ndarray, prior: float, factors: int = FACTORS, steps: int = 1500, seed: int = 7) -> FactorizationMachine:
    """Train on distinct (row, term) pairs of labelled rows, each class with half of the weight.

    ``prior``, the share of label 1 outside the sample, is the score of every row where nothing can be learned.
    """
    n, pos = len(y), float(y.sum())
    odds = lambda p: float(np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4))))
    low = odds(min(prior, 0.49))
    none = FactorizationMachine(np.zeros(0, np.int64), low, np.zeros(0), np.zeros((0, factors)), low)
    if not n or pos in (0, n):
        return none
    ids, at = np.unique(term, return_inverse=True)
    at, row = at.astype(np.int32), row.astype(np.int32)
    order = np.argsort(row, kind="stable")
    cost = np.where(y > 0, 0.5 * n / pos, 0.5 * n / (n - pos))
    s = _Sample(y, cost, at[order], np.searchsorted(row[order], np.arange(n + 1)))
    df = np.bincount(at, minlength=len(ids))
    err = cost * (y - 0.5)
    alone = np.abs(np.bincount(at, weights=err[row], minlength=len(ids)))
    alone /= np.sqrt(np.maximum(np.bincount(at, weights=(err**2)[row], minlength=len(ids)) * (1 - df / (n + 1)), 1e-9))
    alone[df < MIN_TEXTS] = 0
    single = np.flatnonzero(alone >= MIN_Z)
    additive = s.only(single, len(ids))
    b, w = _descend(additive, len(single), 0, steps, seed, np.inf)
    z = b + np.bincount(np.repeat(np.arange(n), np.diff(additive.start)), weights=w[additive.at, 0], minlength=n)
    for _ in range(30):  # the bias to its optimum: else every frequent pair would seem to gain
        p = _probability(z)
        z += np.clip((cost * (y - p)).sum() / max((cost * p * (1 - p)).sum(), 1e-6), -1, 1)
    frequent = np.flatnonzero(df >= MIN_TEXTS)
    frequent = np.sort(frequent[np.argsort(-df[frequent], kind="stable")[:PAIR_TERMS]])
    paired = _pair_gains(s, frequent, len(ids), p)
    gain = np.where(alone >= MIN_Z, alone, 0.0)
    gain[frequent] = np.maximum(gain[frequent], np.where(paired >= MIN_PAIR_Z, paired, 0.0))
    keep = np.flatnonzero(gain)
    if not len(keep):
        return none
    keep = np.sort(keep[np.argsort(-gain[keep], kind="stable")[:MAX_TERMS]])
    b, w = _descend(s.only(keep, len(ids)).with_pieces(seed), len(keep), factors, steps, seed, low)
    return FactorizationMachine(ids[keep].astype(np.int64), b, w[:, 0].copy(), w[:, 1:].copy(), b)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> FactorizationMachine:
    """Fit on a bounded sample of labelled rows whose crc32(doc_id as text) modulo 5 is not 0.

    ``labels`` has doc_id and toxic; the sample takes the lowest hashes of doc_id in each class. One task of an
    executor gets its at most ``2 * rows_per_class`` rows of hashed terms and fits; only the model comes to the driver.
    """
    bounded_batches(spark)
    known = (
        labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1) and crc32(cast(doc_id as string)) % 5 != 0")
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return fit(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), n.get(1, 0) / max(1, sum(n.values())))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for y in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * rows_per_class rows
    joined = docs.select("doc_id", "text").join(sample, "doc_id")
    joined = joined.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "doc_id", "text")  # once, however often it is there
    prior = n[1] / (n[0] + n[1])
    sets = joined.mapInArrow(_term_sets, "y int, doc_id long, terms array<int>").repartition(1)
    found = sets.mapInArrow(partial(_fitted, prior), "terms binary, bias double, weight binary, factor binary, nothing double").first()
    if found is None:  # no labelled row has a document
        return fit(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), prior)
    weight = np.frombuffer(found["weight"])
    return FactorizationMachine(np.frombuffer(found["terms"], np.int64), found["bias"], weight, np.frombuffer(found["factor"]).reshape(len(weight), -1) if len(weight) else np.zeros((0, FACTORS)), found["nothing"])


def _fitted(prior: float, batches):
    """The model of all rows of ``_term_sets``, as one row."""
    got = list(batches)
    if not got:
        return
    rows = pa.Table.from_batches(got).sort_by("doc_id")
    del got
    terms = rows.column("terms").combine_chunks()
    y = rows.column("y").to_numpy().astype(np.float64)
    size = np.diff(terms.offsets.to_numpy())
    del rows
    fm = fit(y, np.repeat(np.arange(len(y), dtype=np.int32), size), terms.flatten().to_numpy(), prior)
    yield pa.RecordBatch.from_pydict({"terms": [fm.terms.tobytes()], "bias": [fm.bias], "weight": [fm.weight.tobytes()], "factor": [fm.factor.tobytes()], "nothing": [fm.nothing]}, pa.schema([("terms", pa.binary()), ("bias", pa.float64()), ("weight", pa.binary()), ("factor", pa.binary()), ("nothing", pa.float64())]))


def _term_sets(batches):
    for batch in batches:
        text = batch.column("text")
        for first, last, data, offsets in tv.chunks(text):
            row, term = hashed_terms(data, offsets)
            row, term, _ = tv.counted(row, term)
            ends = np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(term.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("y")[first:last], batch.column("doc_id")[first:last].cast(pa.int64()), lists], ["y", "doc_id", "terms"])


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``doc_id`` (as it comes) and ``score`` of every whole text; no shuffle, one pass."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = _scorer(docs.sparkSession, model, lambda batch, p: pa.RecordBatch.from_arrays([batch.column("doc_id"), p], ["doc_id", "score"]))
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; no shuffle, one pass."""
    bounded_batches(docs.sparkSession)
    scored = _scorer(docs.sparkSession, model, lambda batch, p: batch.filter(pc.less(p, threshold)))
    return docs.mapInArrow(scored, docs.schema)


def _scorer(spark: SparkSession, model: FactorizationMachine, result):
    """A function of Arrow batches that gives ``result`` each batch and the scores of its texts."""
    shared = spark.sparkContext.broadcast(model)

    def scored(batches):
        fm = shared.value
        near = np.zeros(1 << 16, dtype=bool)  # the low bits of known terms: most words end here
        near[fm.terms & 0xFFFF] = True
        for batch in batches:
            got = [np.zeros(0)]
            for first, last, data, offsets in tv.chunks(batch.column("text")):
                row, term = hashed_terms(data, offsets)
                maybe = near[term & 0xFFFF]
                got.append(fm.score(*fm.find(row[maybe], term[maybe]), last - first))
            yield result(batch, pa.array(np.concatenate(got)))

    return scored


def toxic_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows of ``docs`` and score all of it: doc_id, held_out, score, predicted."""
    return score(docs, train(spark, docs, labels)).select(
        "doc_id",
        F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
