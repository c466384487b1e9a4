"""Words of whole batches at once, on the UTF-8 bytes that Arrow hands over: no Python loop over words.

Texts are taken in runs of a MB, which bounds memory; a longer text is a run of its own. Word hashes are
polynomial sums over a random table of bytes, modulo 2**64, finished by a mixer, so they need one cumulative sum
for all words of a run. All hashes are the same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
_BASE = 0x9E6C63D0876A9A33 | 1
_GRAM = np.uint64(0xD1342543DE82EF95)


def _byte_table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)


def _bytes_of(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


#: The separators of the words [^\x20\x09-\x0D]+
BLANK = _bytes_of("\x20\x09\x0a\x0b\x0c\x0d")
#: For matching across punctuation: every ASCII character but letters and digits separates.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_TABLE = _byte_table()
_TABLE_LOWER = _TABLE[_LOWER]
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, RUN_BYTES)
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which near inputs lie far apart."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Run:
    """Texts lo to hi of a column as one byte array; offsets has one more entry than there are texts."""

    lo: int
    hi: int
    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        sums = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def runs(column: pa.Array, most: int = RUN_BYTES) -> Iterator[Run]:
    """The texts of a string column, in order; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield Run(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """start and end bytes of each word, and the text it is in."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def words(run: Run, separators: np.ndarray = BLANK) -> Words:
    inside = ~separators[run.buf]
    if not len(inside):
        return Words(*(np.zeros(0, dtype=np.int64) for _ in range(3)))
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    before[run.offsets[:-1][run.offsets[:-1] < len(inside)]] = False
    after = np.zeros_like(inside)
    after[:-1] = inside[1:]
    last = run.offsets[1:] - 1
    after[last[last >= 0]] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(run.offsets, start, side="right") - 1)


def span_hashes(run: Run, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; lower: with A-Z as a-z."""
    n = len(run.buf)
    powers, inverses = _grown(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_TABLE_LOWER if lower else _TABLE)[run.buf] * powers[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * inverses[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row within one text, and the first word of each."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    g = h[:m].copy()
    for i in range(1, n):
        g *= _GRAM
        g += h[i : i + m]
    first = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(g[first]), first


def ngram_hash(h: np.ndarray) -> np.uint64:
    """The hash that ngrams gives to the words h as a whole."""
    return ngrams(h, np.zeros(len(h), dtype=np.int64), len(h))[0][0]


class HashSet:
    """Membership of many hashes in a small set: a bit table first, the sorted set for what passes."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        bits = max(12, int(len(self.values) * 32).bit_length())
        self.mask = np.uint64((1 << min(bits, 27)) - 1)
        self.table = np.zeros(int(self.mask) + 1, dtype=bool)
        self.table[(self.values & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h of members, and their ranks in the set."""
        at = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        rank = np.searchsorted(self.values, h[at])
        rank[rank == len(self.values)] = 0
        hit = self.values[rank] == h[at]
        return at[hit], rank[hit]


def utf8_runs(texts: list[str]) -> Run:
    """One run of a few texts, for fixed tables and tests."""
    return next(runs(pa.array(texts, type=pa.string()), 1 << 62))
