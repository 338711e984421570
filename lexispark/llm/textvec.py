"""Vectorised hashing of words and word shingles, straight from Arrow's text buffers.

A word is a run of ASCII letters and digits or of characters above U+007F, after lower-casing A-Z; that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. All hashes are 64 bits, the same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text hashed at once; bounds the size of the work arrays.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from hashed values."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self):
        self.n = 0

    def get(self, n: int):
        if n > self.n or not self.n:
            n = max(n, CHUNK_BYTES + 4096)
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
            self.n = n
        return self.up, self.down


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _Powers()


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``first`` to ``last`` of a text column, their bytes, and each row's offsets in those bytes.

    Nulls count as empty texts. A single text longer than ``CHUNK_BYTES`` is a chunk of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the row that it belongs to."""
    inside = _WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """A hash of the folded bytes of each span, equal for equal bytes."""
    if prefix is None:
        prefix = byte_prefix(data)
    _, down = _POWERS.get(len(data))
    return mix((prefix[e] - prefix[s]) * down[s] + (e - s).astype(U64))


def byte_prefix(data: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.get(len(data))
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((_FOLD[data].astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and its row."""
    s, e, row = word_spans(data, offsets)
    return span_hashes(data, s, e), row


def shingles(word: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of a row, and the row.

    A row of fewer words, but not none, has one shingle: all its words.
    """
    n = len(word)
    if not n:
        return word, row
    first = np.ones(n, dtype=bool)
    first[1:] = row[1:] != row[:-1]
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, n))
    left = np.repeat(begin + length, length) - np.arange(n)  # words from here to the row's end
    keep = (left >= size) | first
    at, have = np.flatnonzero(keep), np.minimum(left[keep], size)
    acc = np.zeros(len(at), dtype=U64)
    for j in range(size):
        on = have > j
        acc[on] = acc[on] * U64(0xD6E8FEB86659FD93) + word[at[on] + j]
    return mix(acc + have.astype(U64)), row[at]


def counted(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) pairs in order, with how often each occurs."""
    if not len(row):
        return row, value, np.zeros(0, dtype=np.int64)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def row_digest(word: np.ndarray, row: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """A hash of each row's whole sequence of words."""
    n = len(word)
    out = np.zeros(rows, dtype=U64)
    if n:
        first = np.ones(n, dtype=bool)
        first[1:] = row[1:] != row[:-1]
        begin = np.flatnonzero(first)
        at = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        up, _ = _POWERS.get(n)
        out[row[begin]] = np.add.reduceat(mix(word ^ U64(salt)) * up[at], begin)
    return mix(out + U64(salt))

