"""The arithmetic of the grid search, in numpy: blocks of documents against all queries, and one query's documents in every
combination. The module travels with the functions, so executors need no copy of this package."""

from __future__ import annotations

import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents times queries of a block.
CELLS = 1 << 17
#: More than the rounding of scores, so that equal ones are not told apart by a bound.
TIES = 1e-8

MATCH = "q_idx long, doc_idx long, r double, tf long, qtf long, df long"
_MATCH = pa.schema([("q_idx", pa.int64()), ("doc_idx", pa.int64()), ("r", pa.float64()), ("tf", pa.int64()), ("qtf", pa.int64()), ("df", pa.int64())])


class Side:
    """The query terms of some queries: ``starts`` has each term's first entry of q (a number in ``ids``), qtf and df."""

    def __init__(self, q_idx, term_id, qtf, df, n_terms: int, n_docs: int, avgdl: float):
        order = np.argsort(term_id, kind="stable")
        self.ids, self.q = np.unique(np.asarray(q_idx)[order], return_inverse=True)
        self.qtf, self.df = np.asarray(qtf)[order], np.asarray(df)[order]
        self.starts = np.searchsorted(np.asarray(term_id)[order], np.arange(n_terms + 1))
        self.n_docs, self.avgdl = n_docs, avgdl

    def relative(self, dl):
        """A document's length by the mean one; without a mean length the length does not count."""
        return dl / self.avgdl if self.avgdl > 0 else np.ones(len(dl))


def weight(n: int, df, kind: str):
    df = np.asarray(df, dtype=float)
    return np.log((n - df + 0.5) / (df + 0.5)) if kind == "rsj" else np.log((n + 1.0) / (df + 1.0))


def saturated(tf, k1: float, norm):
    return tf * (k1 + 1.0) / (tf + k1 * norm)


def repeated(qtf, k3: float):
    q = np.asarray(qtf, dtype=float)
    return np.where((q > 1) & (k3 > 0), q * (k3 + 1.0) / (q + max(k3, 0.0)), 1.0)


class Block:
    """Some documents' postings of query terms, each with every query that has the term: ``at`` is the posting, ``entry``
    the query term and ``key`` the pair (document, query) of a match."""

    def __init__(self, side: Side, batch: pa.RecordBatch):
        hits = batch.column("hits")
        self.doc, values, lengths = batch.column("doc_idx").to_numpy(), hits.flatten(), np.diff(hits.offsets.to_numpy())
        term, self.tf = values.field("id").to_numpy(), values.field("tf").to_numpy().astype(float)
        self.row, self.side, self.shape = np.repeat(np.arange(len(self.doc)), lengths), side, (len(self.doc), len(side.ids))
        self.r = side.relative(batch.column("dl").to_numpy().astype(float))
        n = side.starts[term + 1] - side.starts[term]
        self.at = np.repeat(np.arange(len(term)), n)
        self.entry = np.arange(len(self.at)) + np.repeat(side.starts[term] - (np.cumsum(n) - n), n)
        self.key = self.row[self.at] * len(side.ids) + side.q[self.entry]

    def sums(self, values) -> np.ndarray:
        return np.bincount(self.key, values, self.shape[0] * self.shape[1]).reshape(self.shape)

    def only(self, keep: np.ndarray) -> None:
        """Leave these matches only."""
        at = self.at[keep]
        self.entry, self.key, self.tf, self.row, self.at = self.entry[keep], self.key[keep], self.tf[at], self.row[at], np.arange(len(at))

    def matches(self, pairs: np.ndarray) -> pa.RecordBatch:
        keep = pairs.ravel()[self.key]
        at, entry = self.at[keep], self.entry[keep]
        s, row = self.side, self.row[at]
        columns = (s.ids[s.q[entry]], self.doc[row], self.r[row], self.tf[at].astype("int64"), s.qtf[entry], s.df[entry])
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _MATCH)], schema=_MATCH)


def _blocks(side: Side, batches):
    step = max(1, CELLS // len(side.ids))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield Block(side, part), part


def leaders(side: Side, points: list[tuple], k: int):
    """mapInArrow: (q_idx, point, doc_idx, score), each task's k best documents of each query at each of ``points``."""

    def run(batches):
        best = [(np.empty((0, len(side.ids))), np.empty((0, len(side.ids)), dtype="int64")) for _ in points]
        for block, _ in _blocks(side, batches):
            for p, (k1, b, k3, delta, kind) in enumerate(points):
                w = weight(side.n_docs, side.df, kind)
                part = saturated(block.tf, k1, (1.0 - b + b * block.r)[block.row])
                score = block.sums(part[block.at] * (w * repeated(side.qtf, k3))[block.entry] + delta * w[block.entry])
                score[score == 0] = -np.inf
                score, doc = np.vstack([best[p][0], score]), np.vstack([best[p][1], np.repeat(block.doc[:, None], len(side.ids), 1)])
                if len(score) > k:
                    first = np.argpartition(-score, k - 1, axis=0)[:k]
                    score, doc = np.take_along_axis(score, first, 0), np.take_along_axis(doc, first, 0)
                best[p] = score, doc
        for p, (score, doc) in enumerate(best):
            i, q = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(side.ids[q], pa.int64()), pa.array(np.full(len(q), p), pa.int32()), pa.array(doc[i, q], pa.int64()), pa.array(score[i, q])], ["q_idx", "point", "doc_idx", "score"])

    return run


def asked(side: Side):
    """mapInArrow: the matches of the pairs that the documents' ``asked`` lists."""

    def run(batches):
        for block, part in _blocks(side, batches):
            lists = part.column("asked")
            pairs = np.zeros(block.shape, dtype=bool)
            row, q_idx = np.repeat(np.arange(len(block.doc)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            known = np.isin(q_idx, side.ids)  # a query of unknown terms has no entry
            pairs[row[known], np.searchsorted(side.ids, q_idx[known])] = True
            yield block.matches(pairs)

    return run


def contenders(side: Side, levels: list[tuple[list[tuple], np.ndarray]], deltas: list[float], k3: tuple[float, float]):
    """mapInArrow: the matches of the pairs that no level's bound proves to be below its bars (query, cell, delta).

    A level has cells: a range of k1, one of b and an idf each. The largest saturated frequency of a posting is at the least
    length norm and at one end of k1, the smallest one at the largest norm (it is monotone in k1 and in the norm, the norm in
    b). So a document's sum over a cell is at most that of its postings' largest parts (smallest ones for negative weights).
    """

    def left(block, cells, bars):
        """Which matches are of pairs that reach a bar."""
        pairs, place = np.unique(block.key, return_inverse=True)
        q, some, more = pairs % len(side.ids), np.zeros(len(pairs), dtype=bool), {}
        for c, (ks, bs, kind) in enumerate(cells):
            w = weight(side.n_docs, side.df, kind)
            if kind not in more:
                more[kind] = np.bincount(place, w[block.entry], len(pairs))
            own = (w * np.where(w < 0, repeated(side.qtf, k3[0]), repeated(side.qtf, k3[1])))[block.entry]
            norms = [1.0 - b + b * block.r for b in dict.fromkeys((bs[0], bs[-1]))]
            ends = lambda pick: [saturated(block.tf, k, pick.reduce(norms)[block.row]) for k in dict.fromkeys((ks[0], ks[-1]))]  # noqa: B023, E731
            part = np.maximum.reduce(ends(np.minimum))[block.at]
            if (own < 0).any():
                part = np.where(own < 0, np.minimum.reduce(ends(np.maximum))[block.at], part)
            most = np.bincount(place, own * part, len(pairs))
            for d, delta in enumerate(deltas):
                some |= most + delta * more[kind] >= bars[q, c, d] - TIES
        return some[place]

    def run(batches):
        for block, _ in _blocks(side, batches):
            for cells, bars in levels:
                if len(block.key):
                    block.only(left(block, cells, bars))
            yield block.matches(np.ones(block.shape, dtype=bool))

    return run


def _sums(t: pa.Table, space, n: int):
    """The documents of a query's matches, in order, their sums of weights (idf, document), what k3 makes of a score, and an
    iterator of (place of k1, place of b, sums).

    Sums are (k3, idf, document), a score is a sum and delta times the weights. Values of k3 that come to the same, as where
    no term is repeated, have one row: the third result has the row of each. Matches are put in one order, so that equal
    documents have equal sums."""
    doc, r, tf, qtf, df = (t.column(c).to_numpy() for c in ("doc_idx", "r", "tf", "qtf", "df"))
    order = np.lexsort((tf, qtf, df, doc))
    doc, r, tf, qtf, df = doc[order], r[order], tf[order].astype(float), qtf[order], df[order]
    docs, place = np.unique(doc, return_inverse=True)
    classes, which = np.unique(qtf, return_inverse=True)
    key, size = which * len(docs) + place, (len(classes), len(docs))
    w = [weight(n, df, kind) for kind in space.idf_type]
    more = np.stack([np.bincount(place, x, len(docs)) for x in w])
    repeats, row_of = np.unique([repeated(classes, float(k3)) for k3 in space.k3], axis=0, return_inverse=True)

    def each():
        for i, k1 in enumerate(space.k1):
            for j, b in enumerate(space.b):
                part = saturated(tf, float(k1), 1.0 - b + b * r)
                by_class = np.stack([np.bincount(key, x * part, size[0] * size[1]).reshape(size) for x in w], 1)
                yield i, j, np.stack([sum(f * a for f, a in zip(s, by_class)) for s in repeats])

    return docs, more, row_of.ravel(), each()


def _near_best(sums, more, delta, k: int):
    """Which documents can be among the best k at some delta. Those at its middle are the yardstick: their least score is
    concave in delta and a score is linear, so both ends tell. It counts only where it is positive: 0 is no hit."""
    n = sums.shape[-1]
    first = np.argpartition(sums + np.median(delta) * more, n - k, axis=-1)[..., n - k :]
    own, weights = np.take_along_axis(sums, first, -1), np.take_along_axis(np.broadcast_to(more, sums.shape), first, -1)
    least = [(own + d * weights).min(-1, keepdims=True) for d in (delta.min(), delta.max())]
    valid = (least[0] > TIES) & (least[1] > TIES)
    out = np.zeros(n, dtype=bool)
    for d, bar in zip((delta.min(), delta.max()), least):
        out |= (sums + d * more >= np.where(valid, bar - TIES, -np.inf)).any((0, 1))
    return out


def _hits(sums, more, delta):
    """Scores (k3, delta, idf, document), rounded as in every ranking; a document of score 0 is no hit."""
    out = np.round(sums[:, None] + delta[None, :, None, None] * more, 9)
    out[out == 0] = -np.inf
    return out


def bars_of(space, n: int, k: int):
    """applyInArrow: (q_idx, bars), the least score of a relevant document that may be among the best k, by (k1, b, idf, delta).

    The documents that are there are a yardstick: whoever is below k of them is not among the best."""
    space = SimpleNamespace(**vars(space))  # of no module that an executor lacks

    def run(t):
        (docs, more, _, each), delta = _sums(t, space, n), np.array(space.delta, dtype=float)
        relevant = np.zeros(len(docs), dtype=bool)
        relevant[np.searchsorted(docs, t.column("doc_idx").filter(t.column("relevance").is_valid()).to_numpy())] = True
        out = np.full((len(space.k1), len(space.b), len(space.idf_type), len(space.delta)), np.inf)
        for i, j, sums in each:
            hits = _hits(sums, more, delta)
            own = hits[..., relevant]
            if not own.size:
                break
            least = np.partition(hits, len(docs) - k, axis=-1)[..., len(docs) - k, None] if len(docs) >= k else -np.inf
            out[i, j] = np.where((own >= least - TIES) & (own > -np.inf), own, np.inf).min((0, 3)).T
        return pa.table({"q_idx": t.column("q_idx").slice(0, 1).cast(pa.int64()), "bars": pa.array([out.ravel().tolist()], pa.list_(pa.float64()))})

    return run


def gains_of(space, n: int, k: int):
    """applyInArrow: (combo_id, mrr, ndcg, recall) of a query, from the matches of all documents that count."""
    space = SimpleNamespace(**vars(space))  # of no module that an executor lacks

    def run(t):
        (docs, more, row_of, each), delta = _sums(t, space, n), np.array(space.delta, dtype=float)
        graded = t.filter(t.column("relevance").is_valid())
        grade = np.zeros(len(docs))
        grade[np.searchsorted(docs, graded.column("doc_idx").to_numpy())] = graded.column("relevance").to_numpy()
        idcg, n_rel = (t.column(c)[0].as_py() for c in ("idcg", "n_rel"))
        out = np.zeros((3, len(space.k1), len(space.b), len(space.k3), len(delta) * len(space.idf_type)))
        for i, j, sums in each:
            some = _near_best(sums, more, delta, k) if len(docs) > k else slice(None)
            hits, own = _hits(sums[..., some], more[:, some], delta), grade[some]
            hits = hits.reshape(-1, hits.shape[-1])
            if hits.shape[1] > 2 * k:  # an exact bar, where the yardstick's was none
                some = ((hits >= np.partition(hits, -k, axis=1)[:, -k, None]) & (hits > -np.inf)).any(0)
                hits, own = hits[:, some], own[some]
            first = np.argsort(-hits, axis=1, kind="stable")[:, :k]  # equal ones by doc_idx
            got = np.where(np.take_along_axis(hits, first, 1) > -np.inf, own[first], 0.0)
            ten, rank = got[:, :10], np.arange(1, min(10, got.shape[1]) + 1)
            values = np.where(ten > 0, 1.0 / rank, 0.0).max(1, initial=0.0), (ten / np.log2(rank + 1.0)).sum(1) / (idcg or 1.0), (got[:, :100] > 0).sum(1) / n_rel
            for m, x in enumerate(values):
                out[m, i, j] = x.reshape(len(sums), -1)[row_of]
        mrr, ndcg, recall = out.reshape(3, -1)
        return pa.table({"combo_id": pa.array(np.arange(len(mrr)), pa.int32()), "mrr": mrr, "ndcg": ndcg, "recall": recall})

    return run
