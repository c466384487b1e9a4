"""Scores of an interpolated modified Kneser-Ney n-gram model; the order is a parameter, three words by default.

Counting is done by Spark: words first, which gives every word an id (its rank among all word hashes), then n-grams of
ids, from the highest order down: each distinct n-gram counts once for the n-gram without its first word, which is the
continuation count that the lower orders use. The model is a set of sorted arrays in the shared store, which workers map
into memory, so it may be larger than any worker: word hashes with counts and continuation probabilities, and for each
order shards of sorted context hashes with the sorted ids and counts of the words that follow.

An n-gram is dealt into a shard by the last word of its context; where that is too frequent for one shard also by the
word before, and so on, in the end by the predicted word too. So no shard grows with a single word. Each task adds up its
own n-grams before the shuffle.

Text is lower-cased (A-Z); tokens are words and one end for each text, after order - 1 marks for the beginning. N-grams
that begin with such a mark have their plain count in every order, as nothing else can stand before them. An unknown word
has an equal share of the continuation mass that discounting frees; a context never seen leaves the lower order's value.

Defined results: a null or empty text is just an end; a null id hashes as an empty one; repeated rows count each; where
nothing is learnt from, all counts are 0 and every token has the same probability; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.llm import wordscan as W
from lumenq.llm.columns import Scratch, id_schema, shared_path
from lumenq.llm.store import get_array, get_arrays, put_array, put_arrays

#: Hashes of the two marks that are no words.
BEGIN, END = np.int64(-0x5BD1E995AA55AA55), np.int64(0x2545F4914F6CDD1D)
#: About so many words of the vocabulary, or n-grams, are in a shard; a worker holds one shard at a time while it is built.
SHARD = 2_000_000
#: N-grams that a task gathers before it hands them on.
GATHER = 2_000_000
ORDER = 3
#: Bytes of text that a worker scores at a time.
SCORE_BYTES = 1 << 21
#: Arrays of a shard of n-grams. Contexts are sorted; n words follow each, with sorted ids, and offset has the first place of
#: every eighth context's words. Sums of counts, and how many counts are 1 and 2, are kept for contexts with more than FEW words.
FIELDS = {"context": np.uint64, "offset": np.int64, "word": np.uint32, "large": np.uint32, "tokens": np.int64, "ones": np.uint32, "twos": np.uint32}
FIELDS |= {f"{x}.{y}": t for x in ("count", "n") for y, t in (("at", np.uint32), ("more", np.int64), ("small", np.uint8))}
FEW = 8
#: Words up to which all that follow a context are read at once, FEW or more.
FLAT = 32
#: Words after one context from which they are searched for in a call of their own.
MANY = 4
ROW = "shard long, n long, blob binary, level int, kind int, id long, a long, b long, c long, d long"


@dataclass(frozen=True)
class Model:
    """What workers need besides the arrays. first: id of each vocabulary shard's first word; discounts: from order 1 up."""

    path: str
    order: int
    vocabulary_bits: int
    first: tuple[int, ...]
    shards: int
    hot_shards: int
    tokens: int
    distinct: int
    discounts: tuple[tuple[float, ...], ...]
    unknown: float
    continuations: int


def held_out(id_col: str):
    """crc32 of the id as text, modulo 7, is 2."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7) == 2


def sequences(run: W.Run, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a run with order - 1 beginnings and an end for each text, and the text of each."""
    w = W.words(run)
    h = W.span_hashes(run, w.start, w.end, lower=True).view(np.int64)
    n = len(run)
    sizes = np.bincount(w.doc, minlength=n) + order
    out = np.full(int(sizes.sum()), BEGIN, dtype=np.int64)
    out[np.cumsum(sizes) - 1] = END
    out[np.arange(len(h)) + order * w.doc + order - 1] = h
    return out, np.repeat(np.arange(n), sizes)


def windows(values: np.ndarray, doc: np.ndarray, order: int) -> np.ndarray:
    """One row for each place in the n-gram, one column for each token but the beginnings."""
    n = len(values) - order + 1
    same = doc[:n] == doc[order - 1 :] if n > 0 else np.zeros(0, dtype=bool)
    return np.stack([values[j : j + max(n, 0)][same] for j in range(order)])


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where each distinct one begins in it. Not stable, which makes it several times as fast."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.ones(len(own), dtype=bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    return order, np.flatnonzero(new)


def _back(order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The number of each key's group."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(order)))
    return out


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order, heads = _grouped(keys)
    return keys[order[heads]], np.add.reduceat(counts[order], heads) if len(keys) else counts


def _gathered(batches: Iterator[pa.RecordBatch], keys_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of keys_of(run) over a task's texts, handed on whenever enough have come together."""
    parts, size = [], 0
    for batch in batches:
        for run in W.runs(batch.column(0)):
            keys = keys_of(run)
            order, heads = _grouped(keys)
            keys, counts = keys[order[heads]], np.diff(heads, append=len(order))
            parts.append((keys, counts))
            size += len(keys)
            if size >= 2 * GATHER:
                parts = [_added(parts)]
                size = len(parts[0][0])
                if size >= GATHER:
                    yield parts[0]
                    parts, size = [], 0
    if parts:
        yield _added(parts)


def _count_words(texts: DataFrame) -> DataFrame:
    def count(batches):
        for keys, counts in _gathered(batches, lambda run: sequences(run, 1)[0]):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["h", "c"])

    return texts.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Ids and counts of words, from the mapped shards."""

    def __init__(self, path: str, bits: int, first: tuple[int, ...], common: bool = True):
        self.bits, self.first = bits, np.array(first, dtype=np.int64)
        self.hashes = [get_array(f"{path}/words/{k}.hash", np.int64) for k in range(1 << bits)]
        self.counts = [get_array(f"{path}/words/{k}.count", np.int64) for k in range(1 << bits)]
        self.begin = int(self.find(np.array([BEGIN]))[0][0])
        self.common = get_array(f"{path}/common", np.int64) if common else np.zeros(0, dtype=np.int64)

    def is_common(self, ids: np.ndarray) -> np.ndarray:
        """Whether these are words too frequent for one shard, or the mark of the beginning."""
        return np.isin(ids, self.common)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """id (-1: unknown) and count of each hash; equal hashes are looked up once."""
        order, heads = _grouped(h)
        own, back = h[order[heads]], _back(order, heads)
        ids, counts = np.full(len(own), -1, dtype=np.int64), np.zeros(len(own), dtype=np.int64)
        shard = shard_of_word(own, self.bits)
        cut = np.searchsorted(shard, np.arange((1 << self.bits) + 1))  # own is sorted, so shards are too
        for k in np.flatnonzero(np.diff(cut)):
            there, some = self.hashes[k], slice(cut[k], cut[k + 1])
            if len(there):
                at = np.minimum(np.searchsorted(there, own[some]), len(there) - 1)
                hit = there[at] == own[some]
                ids[some] = np.where(hit, at + self.first[k], -1)
                counts[some] = np.where(hit, self.counts[k][at], 0)
        return ids[back], counts[back]


def shard_of_word(h: np.ndarray, bits: int) -> np.ndarray:
    """Shards follow the order of the hashes."""
    return (h >> np.int64(64 - bits)) + (1 << (bits - 1)) if bits else np.zeros(len(h), dtype=np.int64)


def folded(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return W.mix(h ^ (ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def hashed(ids: np.ndarray) -> np.ndarray:
    """One hash for each column."""
    return reduce(folded, ids, np.full(ids.shape[1], 77, dtype=np.uint64))


def dealt(grams: np.ndarray, vocabulary: Vocabulary, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each n-gram, and whether its context is spread over shards, as all its words are common."""
    h = np.full(grams.shape[1], 99, dtype=np.uint64)
    spread = np.ones(grams.shape[1], dtype=bool)
    for ids in grams[-2::-1]:
        h = np.where(spread, folded(h, ids), h)
        spread &= vocabulary.is_common(ids)
    h = np.where(spread, folded(h, grams[-1]), h)
    return (h % np.uint64(shards)).astype(np.int64), spread


def _write_words(words: DataFrame, path: str, bits: int) -> list[int]:
    """One file of sorted hashes and one of counts for each shard; returns the shards' sizes."""
    shards = 1 << bits
    shard = (F.shiftright("h", 64 - bits) + (1 << (bits - 1))) if bits else F.lit(0)

    def write(batches):
        found: dict[int, list] = {}
        for b in batches:
            s, h, c = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for k in np.unique(s):
                found.setdefault(int(k), []).append((h[s == k], c[s == k]))
        for k, parts in found.items():
            h, c = _added(parts)
            put_array(f"{path}/words/{k}.hash", h)
            put_array(f"{path}/words/{k}.count", c)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(h)])], names=["shard", "n"])

    sizes = words.select(shard.cast("long").alias("s"), "h", "c").repartition(shards, "s").mapInArrow(write, "shard long, n long").collect()
    out = {r["shard"]: r["n"] for r in sizes}
    for k in range(shards):
        if k not in out:
            put_array(f"{path}/words/{k}.hash", np.zeros(0, dtype=np.int64))
            put_array(f"{path}/words/{k}.count", np.zeros(0, dtype=np.int64))
    return [out.get(k, 0) for k in range(shards)]


def _write_common(words: DataFrame, path: str, bits: int, first: tuple[int, ...]) -> None:
    """Sorted ids of the words with more than SHARD tokens, and of the beginning; there are fewer of them than shards."""

    def write(batches):
        h = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in batches])
        put_array(f"{path}/common", np.sort(Vocabulary(path, bits, first, common=False).find(h)[0]))
        yield pa.RecordBatch.from_arrays([pa.array([len(h)])], names=["n"])

    words.filter((F.col("c") > SHARD) | (F.col("h") == F.lit(int(BEGIN)))).select("h").repartition(1).mapInArrow(write, "n long").collect()


class Gathering:
    """Adds up n-grams of a task; full() hands them on whenever enough have come together. Columns of grams are n-grams."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self._put(hashed(grams), grams.astype(np.uint32), counts)

    def _put(self, h: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> None:
        if len(h):
            order, heads = _grouped(h)
            self.parts.append((h[order[heads]], grams[:, order[heads]], np.add.reduceat(counts[order], heads)))
            self.size += len(heads)

    def merge(self) -> None:
        if len(self.parts) > 1:
            parts, self.parts, self.size = self.parts, [], 0
            self._put(*(np.concatenate(x, axis=-1) for x in zip(*parts, strict=True)))

    def full(self, last: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size >= 2 * GATHER or last:
            self.merge()
            if self.parts and (last or self.size >= GATHER):
                (_, grams, counts), self.parts, self.size = self.parts[0], [], 0
                yield grams, counts


def _together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of several lists and their summed counts."""
    all_ = Gathering()
    all_.add(*(np.concatenate(x, axis=-1) for x in zip(*parts, strict=True)))
    return all_.parts[0][1:]


def _rows(level: int, kind: int, ids, *columns, shard: int = 0) -> pa.RecordBatch:
    n = len(ids)
    values = [np.asarray(x, dtype=np.int64) for x in (ids, *columns, *[np.zeros(n)] * (4 - len(columns)))]
    same = [pa.array(np.full(n, x, dtype=np.int32)) for x in (level, kind)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), *same, *map(pa.array, values)], names=NAMES)


NAMES = [x.split()[0] for x in ROW.split(", ")]


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes, and so on: high bytes are alike, so they compress better together."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _joined(raw: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()


def _blobs(grams: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary, shards: int) -> Iterator[pa.RecordBatch]:
    """One row for each shard, with its n-grams sorted by their last two words."""
    press = zstandard.ZstdCompressor(level=3)
    tail = (grams[-2].astype(np.int64) << np.int64(32)) | grams[-1]
    shard, _ = dealt(grams.astype(np.int64), vocabulary, shards)
    order = np.lexsort((tail, shard))
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(cut)):
        own = order[cut[k] : cut[k + 1]]
        most = counts[own].max()
        raw = b"".join(map(_planes, (np.diff(tail[own], prepend=0), grams[:-2, own].ravel(), counts[own].astype(np.uint8 if most < 256 else np.int64))))
        yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([len(own)]), pa.array([press.compress(raw)], type=pa.binary()), pa.array([len(grams)], type=pa.int32()), pa.array([3], type=pa.int32()), *[pa.nulls(1, pa.int64())] * 5], names=NAMES)


def _opened(blob: bytes, n: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = (8 + 4 * (order - 2)) * n
    tail = np.cumsum(_joined(raw[: 8 * n], np.int64))
    front = _joined(raw[8 * n : at], np.uint32).reshape(order - 2, n)
    counts = _joined(raw[at:], np.uint8 if len(raw) - at == n else np.int64).astype(np.int64)
    return np.concatenate([front, (tail >> np.int64(32)).astype(np.uint32)[None], (tail & np.int64(0xFFFFFFFF)).astype(np.uint32)[None]]), counts


def _small(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Values below 255 as bytes, the others beside them with their places."""
    at = np.flatnonzero(values >= 255)
    return {f"{name}.small": np.minimum(values, 255), f"{name}.at": at, f"{name}.more": values[at]}


def _value(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = arrays[f"{name}.small"][at].astype(np.int64)
    if len(big := np.flatnonzero(out == 255)):
        out[big] = arrays[f"{name}.more"][np.searchsorted(arrays[f"{name}.at"], at[big])]
    return out


def _places(arrays: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of the words of each context, and the place behind the last."""
    before = np.minimum((at & ~7)[:, None] + np.arange(7), len(arrays["n.small"]) - 1)
    sizes = np.where(np.arange(7) < (at & 7)[:, None], _value(arrays, "n", before.ravel()).reshape(-1, 7), 0)
    low = arrays["offset"][at >> 3] + sizes.sum(axis=1)
    return low, low + _value(arrays, "n", at)


def _looked_up(arrays: dict[str, np.ndarray], at: np.ndarray, of: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of words, each after the context at[of]; and of each context its tokens, and how many words follow it once, twice, more often."""
    low, high = _places(arrays, at)
    size = high - low
    about, counts = np.zeros((4, len(at)), dtype=np.int64), np.zeros(len(of), dtype=np.int64)
    few = size <= FLAT
    if len(small := np.flatnonzero(few)):
        # all words of contexts with few of them, side by side: one search and one sum for all
        n = size[small]
        head = np.cumsum(n) - n
        flat = np.arange(int(n.sum())) + np.repeat(low[small] - head, n)
        c = _value(arrays, "count", flat)
        there = np.repeat(small << 32, n) | arrays["word"][flat]
        about[:3, small] = [np.add.reduceat(x, head, dtype=np.int64) for x in (c, c == 1, c == 2)]
        own = np.flatnonzero(few[of])
        wanted = of[own] << 32 | word[own]
        place = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
        counts[own] = np.where(there[place] == wanted, c[place], 0)
    if len(small) < len(at):
        large = np.searchsorted(arrays["large"], at[~few].astype(np.uint32))  # of one type, or the whole array would be cast
        about[:3, ~few] = [arrays[x][large] for x in ("tokens", "ones", "twos")]
        own = np.flatnonzero(~few[of])
        place = _within(arrays["word"], low[of[own]], high[of[own]], word[own])
        own, place = own[place >= 0], place[place >= 0]
        counts[own] = _value(arrays, "count", place)
    about[3] = size - about[1] - about[2]
    return counts, about


def _write_shard(uri: str, grams: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]:
    """Adds up the n-grams of a shard and writes its arrays. Returns distinct n-grams, their counts, and rows of statistics:
    kind 0, id 1 to 4: a n-grams have that count; kind 1: the part of a context that is spread over shards, by its hash."""
    order = len(grams)
    context = hashed(grams[:-1])
    by = np.lexsort((grams[-1], context))
    grams, counts, context = grams[:, by], counts[by], context[by]
    new = np.diff(context, prepend=~context[:1]) != 0
    heads = np.flatnonzero(new | (np.diff(grams[-1].astype(np.int64), prepend=-1) != 0))
    counts = np.add.reduceat(counts, heads)
    grams, context, new = grams[:, heads], context[heads], new[heads]
    starts = np.flatnonzero(new)
    tokens, ones, twos, n = (np.add.reduceat(x.astype(np.int64), starts) for x in (counts, counts == 1, counts == 2, np.ones(len(counts))))
    large = np.flatnonzero(n > FEW)
    arrays = {"context": context[starts], "offset": starts[::8], "word": grams[-1], "large": large, "tokens": tokens[large], "ones": ones[large], "twos": twos[large]}
    put_arrays(uri, arrays | _small("count", counts) | _small("n", n), FIELDS)
    rows = [_rows(order, 0, np.arange(1, 5), [(counts == k).sum() for k in range(1, 5)])]
    spread = np.logical_and.reduce([vocabulary.is_common(ids) for ids in grams[:-1, starts].astype(np.int64)])
    if spread.any():
        rows.append(_rows(order, 1, context[starts][spread].view(np.int64), *(x[spread] for x in (tokens, ones, twos, n - ones - twos))))
    return grams, counts, rows


def _count_grams(texts: DataFrame, path: str, order: int, bits: int, first: tuple[int, ...], shards: int) -> DataFrame:
    """Writes the shards of all orders from 2; returns rows of statistics by level (order), kind and id.

    kinds 0 and 1: see _write_shard. kind 2, level 1: a different words stand before word id."""

    def gather(batches):
        vocabulary, found = Vocabulary(path, bits, first), Gathering()
        for batch in batches:
            for run in W.runs(batch.column(0)):
                h, doc = sequences(run, order)
                grams = windows(vocabulary.find(h)[0], doc, order)
                found.add(grams, np.ones(grams.shape[1], dtype=np.int64))
                for ready in found.full():
                    yield from _blobs(*ready, vocabulary, shards)
        for ready in found.full(last=True):
            yield from _blobs(*ready, vocabulary, shards)

    def reduced(level: int):
        def go(batches):
            vocabulary = Vocabulary(path, bits, first)
            blobs: dict[int, list[tuple[int, bytes]]] = {}
            for b in batches:
                kind = b.column(4).to_numpy(zero_copy_only=False)
                if (kind < 3).any():
                    yield b.filter(pa.array(kind < 3))
                for i in np.flatnonzero(kind == 3).tolist():
                    blobs.setdefault(b.column(0)[i].as_py(), []).append((b.column(1)[i].as_py(), b.column(2)[i].as_py()))
            for k in list(blobs):
                parts, size = [], 0
                for n, blob in blobs.pop(k):
                    parts.append(_opened(blob, n, level))
                    size += n
                    if size >= 2 * GATHER:
                        parts = [_together(parts)]
                        size = len(parts[0][1])
                grams, counts = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
                parts.clear()
                grams, counts, rows = _write_shard(f"{path}/grams/{level}/{k}", grams, counts, vocabulary)
                yield from rows
                if level == 2:
                    yield _rows(1, 2, *np.unique(grams[1], return_counts=True))
                else:
                    lower = Gathering()
                    lower.add(grams[1:], np.where(grams[1] == vocabulary.begin, counts, 1))
                    for ready in lower.full(last=True):
                        yield from _blobs(*ready, vocabulary, shards)

        return go

    out = texts.mapInArrow(gather, ROW)
    for level in range(order, 1, -1):
        out = out.repartition(shards, "shard").mapInArrow(reduced(level), ROW)
    return out.groupBy("level", "kind", "id").agg(*[F.sum(x).alias(x) for x in "abcd"])


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many things have the counts 1, 2, 3 and 4; kept within (0, count]."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [k - (k + 1) * y * more / less if less else 0.5 * k for k, less, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _discount_of(counts: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """texts: one column. Learns from every row; order: words of an n-gram, 2 or more."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    path = shared_path(texts.sparkSession, "lm")
    scratch = Scratch(texts.sparkSession, "lm-scratch")
    words = scratch.written(_count_words(texts), "counts")
    distinct, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    if distinct >= 2**31 - 1:
        raise ValueError("n-grams hold ids below 2**31")
    bits = max(0, (distinct // SHARD).bit_length())
    begin = texts.sparkSession.range(1).select(F.lit(int(BEGIN)).alias("h"), F.lit(0).cast("long").alias("c"))
    words = words.unionByName(begin)
    sizes = _write_words(words, path, bits)
    first = tuple(np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist())
    _write_common(words, path, bits, first)
    scratch.clear("counts")
    shards = max(8, -(-tokens // SHARD))
    stats = scratch.written(_count_grams(texts, path, order, bits, first, shards), "statistics")
    low = {(r["level"], r["id"]): r["a"] for r in stats.filter("kind = 0").collect()}  # four rows for each order
    # continuation counts play for words the part that counts play for n-grams
    row = stats.filter("kind = 2").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n"), *[F.count(F.when(F.col("a") == k, 1)).alias(f"n{k}") for k in range(1, 5)], F.count(F.when(F.col("a") > 2, 1)).alias("more")).first()
    discounts = (_discounts([row[f"n{k}"] for k in range(1, 5)]), *(_discounts([low.get((level, k), 0) for k in range(1, 5)]) for level in range(2, order + 1)))
    freed = discounts[0][0] * row["n1"] + discounts[0][1] * row["n2"] + discounts[0][2] * row["more"]
    unknown = (freed / row["n"] if row["n"] else 1.0) / (distinct + 1)
    hot = stats.filter("kind = 1")
    model = Model(path, order, bits, first, shards, 1 + hot.count() // SHARD, tokens, distinct, discounts, unknown, row["n"])
    _write_spread(hot, model)
    _write_probabilities(stats.filter("kind = 2"), model, sizes)
    scratch.clear()
    return model


def _write_spread(hot: DataFrame, m: Model) -> None:
    """Sums of the contexts that are spread over shards: sorted hashes, tokens, and how many words follow once, twice, more often."""

    def write(batches):
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(7)])
            for s, level in np.unique(x[:2], axis=1).T.tolist():
                found.setdefault((s, level), []).append(x[2:, (x[0] == s) & (x[1] == level)])
        for (s, level), parts in found.items():
            x = np.concatenate(parts, axis=1)
            x = x[:, np.argsort(x[0])]
            for name, values in zip(("hash", "a", "b", "c", "d"), x, strict=True):
                put_array(f"{m.path}/spread/{level}/{s}.{name}", values)
        yield pa.RecordBatch.from_arrays([pa.array([len(found)])], names=["n"])

    hot.select(F.pmod("id", F.lit(m.hot_shards)).alias("s"), F.col("level").cast("long"), "id", "a", "b", "c", "d").repartition(m.hot_shards, "s").mapInArrow(write, "n long").collect()


def _write_probabilities(words: DataFrame, m: Model, sizes: list[int]) -> None:
    """The continuation probability of each word, in the order of ids."""
    n = len(m.first)

    def split(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            # empty shards share their first id with the next one; the last of equals holds the words
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(np.array(m.first), ids, side="right") - 1), b.column(0), b.column(1)], names=["s", "id", "a"])

    def write(batches):
        found: dict[int, np.ndarray] = {}
        for b in batches:
            s, ids, a = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for k in np.unique(s).tolist():
                p = found.setdefault(k, np.full(sizes[k], m.unknown))
                p[ids[s == k] - m.first[k]] += np.maximum(a[s == k] - _discount_of(a[s == k], m.discounts[0]), 0) / max(m.continuations, 1)
        for k, p in found.items():
            put_array(f"{m.path}/words/{k}.p", p)
            yield pa.RecordBatch.from_arrays([pa.array([k])], names=["shard"])

    done = {r["shard"] for r in words.select("id", "a").mapInArrow(split, "s long, id long, a long").repartition(n, "s").mapInArrow(write, "shard long").collect()}
    for k in set(range(n)) - done:
        put_array(f"{m.path}/words/{k}.p", np.full(sizes[k], m.unknown))


def _within(words: np.ndarray, low: np.ndarray, high: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Place of each word in its own sorted part words[low:high]; -1 where it is not there."""
    at = low.copy()
    head = np.flatnonzero(np.diff(low, prepend=-1))
    n = np.diff(head, append=len(low))
    for i, size in zip(head[n >= MANY].tolist(), n[n >= MANY].tolist(), strict=True):
        at[i : i + size] += words[low[i] : high[i]].searchsorted(word[i : i + size].astype(np.uint32))
    open_ = np.flatnonzero((low < high) & np.repeat(n < MANY, n))
    low, up, own = low[open_], high[open_], word[open_]
    while len(open_):
        middle = (low + up) >> 1
        less = words[middle] < own
        low, up = np.where(less, middle + 1, low), np.where(less, up, middle)
        at[open_] = low
        going = low < up
        open_, low, up, own = open_[going], low[going], up[going], own[going]
    there = at < high
    there[there] = words[at[there]] == word[there]
    return np.where(there, at, -1)


class Scorer:
    """A worker's view of the model: everything is mapped, nothing loaded."""

    def __init__(self, m: Model):
        self.m = m
        self.vocabulary = Vocabulary(m.path, m.vocabulary_bits, m.first)
        self.p = [get_array(f"{m.path}/words/{k}.p", np.float64) for k in range(len(m.first))]
        self.shards: dict[tuple[int, int], dict[str, np.ndarray] | None] = {}
        self.spread: dict[tuple[int, int], list[np.ndarray] | None] = {}

    def shard(self, level: int, k: int) -> dict[str, np.ndarray] | None:
        if (level, k) not in self.shards:
            try:
                self.shards[level, k] = get_arrays(f"{self.m.path}/grams/{level}/{k}", FIELDS)
            except FileNotFoundError:  # no n-gram was dealt there
                self.shards[level, k] = None
        return self.shards[level, k]

    def spread_shard(self, level: int, s: int) -> list[np.ndarray] | None:
        if (level, s) not in self.spread:
            try:
                self.spread[level, s] = [get_array(f"{self.m.path}/spread/{level}/{s}.{x}", np.int64) for x in ("hash", "a", "b", "c", "d")]
            except FileNotFoundError:
                self.spread[level, s] = None
        return self.spread[level, s]

    def of_word(self, ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), self.m.unknown)
        k = np.searchsorted(self.vocabulary.first, ids, side="right") - 1
        for s in np.unique(k[ids >= 0]):
            some = (k == s) & (ids >= 0)
            out[some] = self.p[s][ids[some] - self.vocabulary.first[s]]
        return out

    def level(self, grams: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each n-gram, with its context's hash, its discounted share of its context's tokens, and the share that discounting frees there (1: unseen)."""
        m, level = self.m, len(grams)
        shard, spread = dealt(grams, self.vocabulary, m.shards)
        # one sort by the first bits of shard, context and word; where others share them, some n-grams are looked up twice
        bits, wide = m.shards.bit_length(), m.distinct.bit_length()
        low = min(wide, 24)
        key = shard.view(np.uint64) << np.uint64(64 - bits) | context >> np.uint64(bits + low) << np.uint64(low) | np.maximum(grams[-1], 0).view(np.uint64) >> np.uint64(wide - low)
        order = np.argsort(key)
        own, word = context[order], grams[-1, order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (own[1:] != own[:-1]) | (word[1:] != word[:-1])
        heads = np.flatnonzero(new)
        back, one = _back(order, heads), order[heads]
        own, freed = self._found(grams[:, one], own[heads], shard[one], spread[one])
        return own[back], freed[back]

    def _found(self, grams: np.ndarray, context: np.ndarray, shard: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """level for n-grams in order of shard, context and word."""
        m, level, n = self.m, len(grams), grams.shape[1]
        counts = np.zeros(n, dtype=np.int64)
        d = m.discounts[level - 1]
        tokens, freed = np.ones(n, dtype=np.int64), np.ones(n)

        def put(which, about: np.ndarray, back=slice(None)) -> None:
            """about: tokens, and how many words follow once, twice, more often; back: the column for each of which."""
            some = np.maximum(about[0], 1)
            tokens[which] = some[back]
            freed[which] = np.where(about[0] > 0, (d[0] * about[1] + d[1] * about[2] + d[2] * about[3]) / some, 1.0)[back]

        cut = np.searchsorted(shard, np.arange(m.shards + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            if (arrays := self.shard(level, k)) is None:
                continue
            own = np.arange(cut[k], cut[k + 1])
            wanted = context[own]
            new = np.ones(len(own), dtype=bool)
            np.not_equal(wanted[1:], wanted[:-1], out=new[1:])
            wanted, of = wanted[new], np.cumsum(new) - 1  # each context is looked up once
            at = np.minimum(np.searchsorted(arrays["context"], wanted), len(arrays["context"]) - 1)
            hit = arrays["context"][at] == wanted
            own, of = own[hit[of]], (np.cumsum(hit) - 1)[of[hit[of]]]
            at = at[hit]
            counts[own], about = _looked_up(arrays, at, of, grams[-1, own])
            put(own, about, of)
        if spread.any():
            some = np.flatnonzero(spread)
            tokens[some], freed[some] = 1, 1.0
            ids = context[some].view(np.int64)
            for s in np.unique(ids % m.hot_shards).tolist():
                if (sums := self.spread_shard(level, s)) is not None:
                    own = np.flatnonzero(ids % m.hot_shards == s)
                    at = np.minimum(np.searchsorted(sums[0], ids[own]), len(sums[0]) - 1)
                    hit = sums[0][at] == ids[own]
                    put(some[own[hit]], np.stack([x[at[hit]] for x in sums[1:]]))
        return np.maximum(counts - _discount_of(counts, d), 0) / tokens, freed

    def score(self, run: W.Run) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, the base score and the score of each text."""
        m, n = self.m, len(run)
        h, doc = sequences(run, m.order)
        ids, counts = self.vocabulary.find(h)
        grams = windows(ids, doc, m.order)
        counts, of = (x[m.order - 1 :][doc[: len(doc) - m.order + 1] == doc[m.order - 1 :]] for x in (counts, doc))
        base = np.bincount(of, weights=np.log10((counts + 1) / (m.tokens + m.distinct + 1)), minlength=n)
        p = self.of_word(grams[-1])
        for level in range(2, m.order + 1):
            part = grams[-level:]
            seen = np.flatnonzero((part[:-1] >= 0).all(axis=0))
            if not len(seen):
                continue
            if len(seen) == part.shape[1]:
                seen = slice(None)
            part = part[:, seen]
            own, freed = self.level(part, hashed(part[:-1]))
            p[seen] = own + freed * p[seen]
        score = np.bincount(of, weights=np.log10(p), minlength=n)
        return np.bincount(of, minlength=n), np.bincount(of, weights=counts > 0, minlength=n).astype(np.int64), base, score


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    schema = id_schema(docs, id_col, "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    rows = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("i"), held_out(id_col).alias("h"))

    def judge(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.score(run) for run in W.runs(batch.column(0), SCORE_BYTES)]
            if found:
                n, known, base, score = (np.concatenate(x) for x in zip(*found, strict=True))
                arrays = [batch.column(1).cast(types.field(0).type), batch.column(2), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(score), pa.array(10.0 ** (-score / n))]
                yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, types.types, strict=True)], schema=types)

    return rows.mapInArrow(judge, schema)
