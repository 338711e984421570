"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Three patterns find the plain cases (``BASE``). The matches are cut out of the long runs of token
characters, and what is left of a run is compared under two second-order character models, one of random strings and
one of ordinary identifiers; where a piece's log-likelihood ratio is above the threshold, it is a span of kind ``markov``.

Defined results: a null text has no spans; offsets are code points, the end exclusive; texts are scanned whole,
very long ones too; repeated rows get equal results; rows without an id are scanned like others; an empty table gives
an empty result, and only generated strings and names train the models; other columns, whatever their names, pass
unread. Spans of different kinds may overlap (a hexadecimal value of an assignment is two spans), but a
``markov`` span overlaps none of the others.
"""

from __future__ import annotations

import bisect
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.runtime import bounded_batches

# The patterns and least lengths of the base scan.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

#: Runs of token characters that the models compare, and the least length of what is left of one beside other spans.
PIECE = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Bounds of the sample that trains the models: documents, and tokens of each label.
SAMPLE_DOCS, SAMPLE_TOKENS = 2000, 20_000
# Words that names in programs are made of.
NAME_WORDS = (
    "account action active address album alpha amount array average backup balance batch block border bound branch bridge buffer build button cache "
    "callback cancel channel check child client cluster code collect color column command commit compare config connect context control copy count "
    "create current cursor data date decode default delete delta detail device digest direct display document domain download driver editor element "
    "encode engine entry error event example export factor failed feature field file filter final finish first flag float folder format frame from "
    "function gateway general global graph group handle header height history host image import index input insert integer item join kernel label "
    "language last layer layout length level library limit line link list load local location lock login lower manager map margin master matrix "
    "maximum member memory merge message method metric minimum model module monitor name network next node normal notice number object offset option "
    "order output owner package page parent parse path pattern pending phone point policy position prefix process product profile project property "
    "provider public query queue random range record region register remote remove render report request reset resource result return rotate round "
    "route sample schedule schema scope screen search second section select sender sequence server service session setting shape shared signal simple "
    "size sort source space split stack stage start state static status storage store stream string style submit summary switch symbol system table "
    "target task template test text thread time title total trace transfer tree trigger type union unique update upload user valid value vector "
    "version view visible weight width window worker write zone"
).split()
SPAN = "array<struct<kind:string,start:int,end:int>>"

_CODE = np.zeros(256, dtype=np.int64)
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 1):
    _CODE[_c] = _i
_N = int(_CODE.max()) + 1


@dataclass
class MarkovPair:
    """``ratio[a, b, c]``: log of how much likelier c is after a, b in random strings than in identifiers."""

    ratio: np.ndarray
    threshold: float

    def ratios(self, tokens: list[str]) -> np.ndarray:
        """The mean log-likelihood ratio a character of each (ASCII) token."""
        code, start = _codes(tokens)
        return np.add.reduceat(self.ratio[_contexts(code, start)], start) / np.diff(np.append(start, len(code))) if tokens else np.zeros(0)


def _codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in tokens], dtype=np.int64)
    return _CODE[np.frombuffer("".join(tokens).encode("ascii"), dtype=np.uint8)], np.cumsum(size) - size


def _contexts(code: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Flat indices (a, b, c) of each character and the two before it; 0 stands before a token's start."""
    one, two = np.roll(code, 1), np.roll(code, 2)
    one[start], two[start] = 0, 0
    two[np.minimum(start + 1, len(code) - 1)] = 0
    return (two * _N + one) * _N + code


def fit(random_strings: list[str], identifiers: list[str]) -> MarkovPair:
    """Train both models; the threshold lies between the labelled scores, nearer to the random strings.

    Second-order counts are smoothed with the first-order shares, and those with the characters' own.
    """

    def log_model(tokens: list[str]) -> np.ndarray:
        at = _contexts(*_codes(tokens)) if tokens else np.zeros(0, np.int64)
        tri = np.bincount(at, minlength=_N**3).reshape(_N, _N, _N).astype(float)
        bi = tri.sum(0)
        p0 = (bi.sum(0) + 0.5) / (bi.sum() + 0.5 * _N)
        p1 = (bi + 2.0 * p0) / (bi.sum(1, keepdims=True) + 2.0)
        return np.log((tri + 4.0 * p1) / (tri.sum(2, keepdims=True) + 4.0)).ravel()

    half = lambda x, k: [t for i, t in enumerate(x) if i % 4 == 3] if k else [t for i, t in enumerate(x) if i % 4 != 3]
    pair = MarkovPair(log_model(half(random_strings, 0)) - log_model(half(identifiers, 0)), 0.0)
    bad, good = pair.ratios(half(random_strings, 1)), pair.ratios(half(identifiers, 1))
    high = float(np.quantile(good, 0.9999)) if len(good) else 0.0
    low = float(np.quantile(bad, 0.02)) if len(bad) else 1.0
    pair.threshold = max(0.35, high, (high + low) / 2)
    return pair


def generated(seed: int = 11, n: int = 4000) -> list[str]:
    """Random strings as keys are: hexadecimal, base 32, base 62 or base 64 characters."""
    rng = random.Random(seed)
    digits = "0123456789"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = (digits + "abcdef", upper + "234567", upper + upper.lower() + digits, upper + upper.lower() + digits + "+/", upper.lower() + digits)
    return ["".join(rng.choices(rng.choice(kinds), k=rng.randint(16, 48))) for _ in range(n)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns' matches, leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out


def _meets(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the sorted, non-overlapping spans has a position in common with start to end."""
    i = bisect.bisect_left(spans, (end, 0))
    return i > 0 and spans[i - 1][1] > start


def _uncovered(covers: list[list[tuple[int, int]]], start: int, end: int) -> list[tuple[int, int]]:
    """The pieces of start to end, of ``PIECE`` characters or more, that none of the sorted spans covers."""
    inside = sorted((s, e) for c in covers for s, e in c[max(0, bisect.bisect_left(c, (start, 0)) - 1) : bisect.bisect_left(c, (end, 0))])
    out, at = [], start
    for s, e in [*inside, (end, end)]:
        if s - at >= PIECE:
            out.append((at, s))
        at = max(at, e)
    return out


def scan(texts: list[str | None], pair: MarkovPair | None) -> list[list[tuple[int, int, int]]]:
    """All spans of each text, sorted; without models only those of the patterns."""
    found, runs, places = [], [], []
    for i, text in enumerate(texts):
        spans = base_spans(text) if text else []
        covers = [[(s, e) for s, kind, e in spans if kind == k] for k in (0, 1)]
        for r in RUN.finditer(text) if text else ():
            run, at = r[0], r.start()
            hexes = [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(run) if m.end() - m.start() >= LEAST["hex"]]
            spans += hexes  # a run of 24 hexadecimal digits is always inside such a run of token characters
            for s, e in _uncovered([*covers, [(s, e) for s, _, e in hexes]], at, r.end()):
                runs.append(text[s:e])
                places.append((i, s, e))
        found.append(spans)
    if pair is not None and runs:
        for (i, s, e), x in zip(places, pair.ratios(runs), strict=True):
            if x > pair.threshold:
                found[i].append((s, 3, e))
    return [sorted(x) for x in found]


def train(docs: DataFrame) -> MarkovPair:
    """Fit on a bounded sample: base matches and generated strings are random, other runs and joined words are not.

    The sample is the ``SAMPLE_DOCS`` documents with the lowest hashes of doc_id, and of their tokens the
    ``SAMPLE_TOKENS`` of each label with the lowest hashes; only these come to the driver.
    """
    bounded_batches(docs.sparkSession)
    ids = F.broadcast(docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS))
    tokens = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(_labelled, "token string, secret boolean").distinct()
    parts = [tokens.where(F.col("secret") == x).orderBy(F.xxhash64("token"), "token").limit(SAMPLE_TOKENS) for x in (True, False)]
    got = parts[0].unionByName(parts[1]).toArrow().to_pylist()
    pick = lambda x: sorted(r["token"] for r in got if r["secret"] == x)
    ordinary = pick(False)
    rng = random.Random(5)
    names = sorted({*NAME_WORDS, *(w for t in ordinary for w in re.split(r"[^a-z]+", t.lower()) if 3 < len(w) < 14)})
    joined = ["_".join(rng.choices(names, k=rng.randint(2, 4)))[:60] for _ in range(2000)]
    camel = ["".join(w.title().replace("_", "") for w in rng.choices(names, k=rng.randint(2, 4)))[:60] for _ in range(2000)]
    numbers = ["".join(rng.choices("0123456789", k=rng.randint(16, 24))) for _ in range(1000)]  # ids and card numbers are no keys
    mixed = [w for w in joined + camel if RUN.fullmatch(w)]
    mixed += numbers + [w.upper() for w in mixed] + [w.lower() for w in mixed]
    made = generated()
    rng.shuffle(mixed)
    # The corpus's other runs are ordinary unless models of names and generated strings alone find them as random as most
    # generated strings are: a key that no pattern finds must not teach what is ordinary.
    first = fit(made, mixed)
    far = np.quantile(first.ratios(made), 0.4)
    ordinary = [w for w, x in zip(ordinary, first.ratios(ordinary)) if x <= far]
    mixed += [w.upper() for w in ordinary] + ordinary
    randoms = pick(True) + made
    rng.shuffle(mixed)
    rng.shuffle(randoms)
    return fit(randoms, mixed)


def _labelled(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        token, secret = [], []
        for text, spans in zip(texts, scan(texts, None), strict=True):
            covers = [[(s, e) for s, kind, e in spans if kind == k] for k in (0, 1, 2)]
            for r in RUN.finditer(text or ""):
                token.append(r[0])
                secret.append(any(_meets(c, r.start(), r.end()) for c in covers if c))
            for s, kind, e in spans:
                if kind == 0:
                    value = ASSIGN.match(text, s, e)
                    if value and RUN.fullmatch(value[2]):
                        token.append(value[2])
                        secret.append(True)
        yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(secret, pa.bool_())], ["token", "secret"])


def _spans(found: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [x for f in found for x in f]
    fields = [pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int32()), pa.array([e for _, _, e in flat], pa.int32())]
    ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["kind", "start", "end"]))


def find(docs: DataFrame, pair: MarkovPair) -> DataFrame:
    """``doc_id`` and ``spans`` of every whole text; one pass, no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pair)

    def scanned(batches):
        for batch in batches:
            spans = _spans(scan(batch.column("text").to_pylist(), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, spans {SPAN}")


def cut(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or group of overlapping spans, replaced by a mark."""
    out, done = [], 0
    for s, kind, e in spans:
        if s >= done:
            out += [text[done:s], f"[{KINDS[kind].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, pair: MarkovPair) -> DataFrame:
    """``docs`` with secrets cut from ``text``, and ``n_chars`` (where there is one) set anew for those rows."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pair)
    names = docs.columns

    def redacted(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = scan(texts, shared.value)
            if any(found):
                new = [cut(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                columns = list(batch.columns)
                columns[names.index("text")] = pa.array(new, batch.schema.field("text").type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    size = pa.array([len(t or "") for t in new], pa.int64()).cast(columns[k].type)
                    columns[k] = pc.if_else(pa.array([bool(s) for s in found]), size, columns[k])
                batch = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield batch

    return docs.mapInArrow(redacted, docs.schema)


def joined(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every document; models trained on a sample of the same table."""
    found = find(docs, train(docs))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
