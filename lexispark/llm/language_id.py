"""Language identification by error-correcting output codes.

Each language has a binary codeword. For each bit a logistic classifier over hashed character n-grams (one to
four bytes of the lower-cased letters) predicts the bit, and the codeword with the least loss, weighted by how
reliable each bit was in training, names the language. A text whose best two codewords are close is ambiguous.

Defined results: a null text, or one without a letter, is ``und`` with score 0; repeated rows get equal results, and a
doc_id of several rows is learned from once; every ``lang`` value of the labelled rows is learned, however many there
are (each from fewer rows then); a null doc_id is not held out and not learned from; texts are read whole; an empty
table gives an empty result; with no labelled row every text is ``und``, and with one language in the labels every text
with a letter is that language. Other columns, whatever their names, pass unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.llm import textvec as tv
from lexispark.llm.runtime import bounded_batches

UND = "und"
#: Hashed n-gram features, and the longest n-gram in bytes.
BITS, LONGEST = 12, 4
#: Labelled rows that training may read for each language (those with the lowest hashes of doc_id), and for all of them:
#: a bound on the fitted sample, which many languages share.
ROWS_PER_LANGUAGE, MOST_ROWS = 800, 16_000
#: Tasks that one language's candidates for the sample are dealt to.
SHARES = 64
#: A text is ambiguous if the second codeword's probability is at least this share of the first's.
CLOSE = 0.5

_DIM = 1 << BITS


@dataclass
class OutputCodes:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weight: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit; sums to 1
    sharp: float  # calibrates the losses to probabilities

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number, its probability, and whether the second is close."""
        margin = features @ self.weight + self.bias
        p = -self.sharp * losses(margin, self.code, self.trust)
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        top = p[np.arange(len(p)), best]
        rest = np.where(np.arange(p.shape[1]) == best[:, None], 0.0, p).max(axis=1)
        return best, top, rest >= CLOSE * top


def losses(margin: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Each text's weighted loss to each codeword: texts x languages."""
    up, down = np.logaddexp(0.0, -margin) * trust, np.logaddexp(0.0, margin) * trust
    return up @ (code > 0).T.astype(up.dtype) + down @ (code < 0).T.astype(up.dtype)


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """Codewords of n classes: every split of up to five classes, else random bits of the largest least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    rng, bits, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        far = ((bits - code @ code.T) / 2 + np.eye(n) * bits).min()
        if far > most:
            best, most = code, far
    return best


def letters(column: pa.Array) -> pa.Array:
    """The text in lower case with every run of other characters than letters as one space."""
    low = pc.utf8_lower(column.fill_null(""))
    return pc.replace_substring_regex(low, r"[^\pL]+", " ")


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square-rooted and scaled counts of each text's hashed n-grams: texts x features."""
    n, rows = len(data), len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    room = offsets[1:][row] - np.arange(n)  # bytes to the end of the text
    h = np.zeros(n, dtype=np.uint32)
    out = np.zeros((rows, _DIM), dtype=np.float32)
    for k in range(LONGEST):
        if n <= k:
            break
        h = h[: n - k] * np.uint32(0x01000193) + data[k:].astype(np.uint32) + np.uint32(1)
        at = room[: n - k] > k
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        slot = (mixed >> np.uint32(32 - BITS)).astype(np.int64)
        out += np.bincount((row[: n - k] * _DIM + slot)[at], minlength=rows * _DIM).reshape(rows, _DIM)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts x features, has a letter); for columns of bounded size."""
    parts, some = [np.zeros((0, _DIM), np.float32)], [np.zeros(0, bool)]
    for x, s in _feature_chunks(column):
        parts.append(x)
        some.append(s)
    return np.concatenate(parts), np.concatenate(some)


def _feature_chunks(column: pa.Array):
    for _, _, data, offsets in tv.chunks(letters(column)):
        for i in range(0, len(offsets) - 1, 256):  # short texts: bounds the dense rows
            o = offsets[i : i + 257]
            part = data[o[0] : o[-1]]
            spaces = np.concatenate([[0], np.cumsum(part == 32)])[o - o[0]]
            yield _ngrams(part, o - o[0]), np.diff(o) > np.diff(spaces)


#: Rows of features that training holds as floating-point numbers at once.
ROWS_AT_ONCE = 4000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(x: np.ndarray, lang: list[str], rounds: int = 150) -> OutputCodes:
    """Train the bits' classifiers on rows of features (counts or shares of any scale); a quarter of the rows weighs the
    bits and the loss. A class with a row in neither part has its rows in both."""
    languages = sorted(set(lang))
    code = codewords(len(languages))
    if len(languages) <= 1:
        return OutputCodes(languages, code, np.zeros((_DIM, 1), np.float32), np.ones(1, np.float32), np.ones(1), 1.0)
    number = {v: i for i, v in enumerate(languages)}
    y = np.array([number[v] for v in lang])
    held = np.arange(len(y)) % 4 == 3
    if held.sum() < len(languages) or set(y[~held]) != set(y):
        held[:] = False
    sign = code[y].astype(np.float32)
    share = np.bincount(y, minlength=len(languages))
    cost = (len(y) / (len(languages) * share[y])).astype(np.float32)[:, None]
    w, b = np.zeros((_DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    fitted = np.flatnonzero(~held)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, rounds + 1):  # Adam on all rows, some at a time
        gw, gb = np.zeros_like(w), np.zeros_like(b)
        for rows in np.array_split(fitted, -(-len(fitted) // ROWS_AT_ONCE)):
            xt, st = _unit(x[rows]), sign[rows]
            err = -st / (1 + np.exp(np.clip(st * (xt @ w + b), -30, 30))) * cost[rows]
            gw += xt.T @ err
            gb += err.sum(0)
        for p, g, m1, m2 in ((w, gw / len(fitted) + 1e-6 * w, m, v), (b, gb / len(fitted), mb, vb)):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            p -= 0.3 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    check = held if held.any() else ~held
    margin = np.concatenate([_unit(x[r]) @ w + b for r in np.array_split(np.flatnonzero(check), -(-int(check.sum()) // ROWS_AT_ONCE))])
    right = (margin * sign[check] > 0).mean(axis=0)
    trust = np.log((right + 1e-3) / (1 - right + 1e-3)).clip(1e-3)
    model = OutputCodes(languages, code, w, b, trust / trust.sum(), 1.0)
    best = np.inf
    for sharp in (0.5, 1.0, 2.0, 4.0, 8.0, 16.0):
        loss = sharp * losses(margin, code, model.trust)
        nll = (loss[np.arange(len(loss)), y[check]] + np.log(np.exp(-loss).sum(axis=1))).mean()
        if nll < best - 1e-4:
            best, model.sharp = nll, sharp
    return model


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, most_rows: int = MOST_ROWS) -> OutputCodes:
    """Fit on a bounded sample of rows with a language and crc32(doc_id as text) modulo 3 other than 1.

    Of each language the ``rows_per_language`` ids with the lowest hashes are taken, or fewer where all languages
    together would exceed ``most_rows`` (one at least). One scan finds them: a window that keeps so many of each
    language in every task before anything is shuffled. Their texts go to Python on the executors; the driver gets their
    n-gram counts, one byte each, at most ``most_rows`` (or one for each language) of ``2 ** BITS`` bytes.
    """
    bounded_batches(docs.sparkSession)
    known = docs.select("doc_id", "lang").where("lang is not null and doc_id is not null and crc32(cast(doc_id as string)) % 3 != 1")
    languages = known.agg(F.count_distinct("lang")).first()[0]
    if not languages:
        return OutputCodes([], np.zeros((0, 1)), np.zeros((_DIM, 1), np.float32), np.zeros(1, np.float32), np.ones(1), 1.0)
    each = max(1, min(rows_per_language, most_rows // languages))
    least = lambda df, *keys: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("_n") <= each).drop("_n")
    # A language's candidates (``each`` of every task) meet in SHARES tasks first, and what these keep in one.
    ids = least(least(known.withColumn("_share", F.spark_partition_id() % SHARES), "lang", "_share"), "lang")
    ids = ids.groupBy("doc_id").agg(F.min("lang").alias("y"))
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most most_rows ids, or one for each language
    once = picked.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = once.select("doc_id", "y", "text").mapInArrow(_sampled, "doc_id long, y string, x binary").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return fit(np.zeros((0, _DIM), np.uint8), [])
    x = np.stack([np.frombuffer(v, np.uint8) for v in rows.column("x").to_pylist()])
    return fit(x, rows.column("y").to_pylist())


def _sampled(batches):
    for batch in batches:
        x, some = features(batch.column("text"))
        top = np.maximum(x.max(axis=1, keepdims=True), 1e-9) if len(x) else x
        coarse = np.round(x / top * 255).astype(np.uint8) if len(x) else x
        out = pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y"), pa.array([v.tobytes() for v in coarse], pa.binary())], ["doc_id", "y", "x"])
        yield out.filter(pa.array(some))


def predict(docs: DataFrame, model: OutputCodes) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every whole text; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches):
        m = shared.value
        names = np.array([*m.languages, UND], dtype=object)
        for batch in batches:
            best, score, close = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
            for x, some in _feature_chunks(batch.column("text")):
                b, p, c = m.decode(x) if m.languages else (np.full(len(x), 0), np.zeros(len(x)), np.zeros(len(x), bool))
                best.append(np.where(some, b, len(m.languages)))
                score.append(np.where(some, p, 0.0))
                close.append(c & some)
            columns = [batch.column("doc_id"), pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(close))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predicted, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def identified(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows of ``docs`` and predict all of it."""
    held = F.expr("coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)").alias("held_out")
    return predict(docs, train(docs)).select("doc_id", held, "lang_pred", "score", "ambiguous")
