"""Benchmark decontamination by greedy string tiling.

Seeds, runs of five words that a document shares with a test item, are joined by hash; for each such pair the item is
tiled with the document's text: running Karp-Rabin finds the longest common runs of words, which are marked without
overlap, longest first, until none of at least min_tile words is left. An item is leaked where its tiles cover the
threshold's share of its words. Order does not matter, so reordered passages are found.

Words are runs of letters and digits with A-Z lower-cased, so punctuation and case make no difference. Defined
results: null or empty texts match nothing; items of fewer words than a seed match nothing, as so few words are no
evidence; equal documents or items each give rows of their own, also such with null ids; empty tables give empty
results; further columns are ignored.

A benchmark of a few MB, which is checked, goes to the workers whole, so documents need no shuffle. A larger one is
joined, and nothing of it reaches the driver: its seeds lie sorted in the shared store, documents give only their words
in such seeds, and texts meet items by seed. An item's most frequent seeds that together cover less than the threshold
make no pair, as a leak must share another one, too; so what thousands of items begin with pairs nothing. Both ways
give the same rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm import wordscan as W
from lumenq.llm.columns import Scratch, in_small_batches, map_batches, plain_names, written
from lumenq.llm.hashsets import StoredHashes, store_hashes

#: Most bytes of ids and texts of a benchmark that goes to the workers whole.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Settings:
    """seed: words of a seed. min_tile: least words of a tile. threshold: share of an item's words that tiles must cover."""

    seed: int = 5
    min_tile: int = 5
    threshold: float = 0.8
    first_search: int = 20

    def __post_init__(self):
        if self.min_tile < self.seed:
            raise ValueError("a tile without a seed would not be found")


class Items:
    """A small benchmark: the words of its items, and which items have a seed. Sent to every worker."""

    def __init__(self, rows: list[tuple], seed: int):
        run = W.utf8_runs([t for _, t in rows])
        w = W.words(run, W.NOT_ALNUM)
        h = W.span_hashes(run, w.start, w.end, lower=True)
        at = np.searchsorted(w.doc, np.arange(len(rows) + 1))
        self.ids = [i for i, _ in rows]
        self._known: dict[int, set[int]] = {}
        self.words = [h[at[i] : at[i + 1]].tolist() for i in range(len(rows))]
        g, first = W.ngrams(h, w.doc, seed)
        self.seeds = W.HashSet(g)
        pairs, times = np.unique(np.stack([np.searchsorted(self.seeds.values, g), w.doc[first]], axis=1), axis=0, return_counts=True) if len(g) else (np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64))
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.seeds.values) + 1))
        self.item, self.times = pairs[:, 1], times
        self.sizes = np.diff(at)

    def pairs(self, run: W.Run, s: Settings) -> Iterator[tuple[int, int, list[int], list[int]]]:
        """(text, item, words of the text that lie in shared seeds, their places), for pairs whose shared seeds could cover enough of the item."""
        w = W.words(run, W.NOT_ALNUM)
        h = W.span_hashes(run, w.start, w.end, lower=True)
        g, first = W.ngrams(h, w.doc, s.seed)
        hit, rank = self.seeds.find(g)
        if not len(hit):
            return
        at, doc = first[hit], w.doc[first[hit]]
        # each text and seed once: the words of an item in its shared seeds bound what tiles can cover
        seen = np.unique(np.stack([doc, rank], axis=1), axis=0)
        n = self.first[seen[:, 1] + 1] - self.first[seen[:, 1]]
        entry = np.repeat(self.first[seen[:, 1]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        both = np.repeat(seen[:, 0], n) * len(self.ids) + self.item[entry]
        pair, back = np.unique(both, return_inverse=True)
        most = s.seed * np.bincount(back, weights=self.times[entry])
        pair = pair[most >= s.threshold * self.sizes[pair % len(self.ids)]]
        if not len(pair):
            return
        cut = np.searchsorted(doc, np.arange(len(run) + 1))
        for p in pair.tolist():
            i, item = divmod(p, len(self.ids))
            own = slice(int(cut[i]), int(cut[i + 1]))
            here = [a for a, r in zip(at[own].tolist(), rank[own].tolist(), strict=True) if item in self._items_of(r)]
            where = sorted({x for a in here for x in range(a, a + s.seed)})
            yield i, item, h[where].tolist(), where

    def _items_of(self, rank: int) -> set[int]:
        if rank not in self._known:
            self._known[rank] = set(self.item[self.first[rank] : self.first[rank + 1]].tolist())
        return self._known[rank]


def tiles(pattern: list[int], text: list[int], places: list[int], min_tile: int, first_search: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in the pattern, start in the text, words), longest first. Text words that are no neighbours by places never share a tile."""
    marked_p, marked_t = [False] * len(pattern), [False] * len(text)
    out: list[tuple[int, int, int]] = []
    search = max(min_tile, min(first_search, len(pattern)))
    while True:
        longest, matches = _matches(pattern, text, places, marked_p, marked_t, search)
        if longest > 2 * search:
            search = longest  # very long common runs first
            continue
        for n, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not any(marked_p[p : p + n]) and not any(marked_t[t : t + n]):
                marked_p[p : p + n] = [True] * n
                marked_t[t : t + n] = [True] * n
                out.append((p, t, n))
        # what a longer tile cut short is found again, shorter, in the next round
        if search == min_tile and not _matches(pattern, text, places, marked_p, marked_t, search)[1]:
            return out
        search = max(min_tile, search // 2)


_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _rolling(words: list[int], marked: list[bool], places: list[int] | None, n: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin hashes of all runs of n unmarked neighbouring words."""
    top = pow(_BASE, n - 1, _MOD)
    h = length = 0
    for i, x in enumerate(words):
        if marked[i]:
            h = length = 0
            continue
        if length and places is not None and places[i] != places[i - 1] + 1:
            h = length = 0
        if length == n:
            h = (h - words[i - n] * top) % _MOD
            length -= 1
        h = (h * _BASE + x) % _MOD
        length += 1
        if length == n:
            yield i - n + 1, h


def _matches(pattern, text, places, marked_p, marked_t, n) -> tuple[int, list[tuple[int, int, int]]]:
    """Maximal common runs of at least n unmarked words, and the longest length."""
    known = defaultdict(list)
    for p, h in _rolling(pattern, marked_p, None, n):
        known[h].append(p)
    longest, out = 0, []
    for t, h in _rolling(text, marked_t, places, n):
        for p in known.get(h, ()):
            if p and t and not marked_p[p - 1] and not marked_t[t - 1] and places[t] == places[t - 1] + 1 and pattern[p - 1] == text[t - 1]:
                continue  # part of the match that began one word before
            k = 0
            while p + k < len(pattern) and t + k < len(text) and pattern[p + k] == text[t + k] and not marked_p[p + k] and not marked_t[t + k] and (k == 0 or places[t + k] == places[t + k - 1] + 1):
                k += 1
            if k >= n:
                out.append((k, p, t))
                longest = max(longest, k)
    return longest, out


def _found(column: pa.Array, items: Items, s: Settings) -> Iterator[tuple[int, int, list[tuple[int, int, int]], int]]:
    """(row, item, tiles with places in the text, words covered) of every leak in a column."""
    for run in W.runs(column):
        starts: np.ndarray | None = None
        for doc, item, text, places in items.pairs(run, s):
            pattern = items.words[item]
            laid = tiles(pattern, text, places, s.min_tile, s.first_search)
            covered = sum(n for _, _, n in laid)
            if covered and covered >= s.threshold * len(pattern):
                if starts is None:
                    w = W.words(run, W.NOT_ALNUM)
                    starts = np.searchsorted(w.doc, np.arange(len(run) + 1))
                yield run.lo + doc, item, [(p, places[t] - int(starts[doc]), n) for p, t, n in laid], covered


_FOUND = "n_item_words long, n_covered long, coverage double, tiles array<struct<item_start: long, doc_start: long, n_words: long>>"


def _small(benchmark: DataFrame, item_col: str, text_col: str, s: Settings, most: int) -> list[tuple] | None:
    """(id, text) of all items that can have a seed, or None where they have more bytes than most."""
    table = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter(F.octet_length("t") >= 2 * s.seed - 1)
    size = F.octet_length("t").cast("long") + F.coalesce(F.octet_length(F.col("i").cast("string")), F.lit(0))
    if (table.agg(F.sum(size)).first()[0] or 0) > most:
        return None
    return sorted(((r["i"], r["t"]) for r in table.collect()), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", settings: Settings = Settings(), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item that it leaks: coverage and tiles. The item id comes back as item_id."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType), *T.StructType.fromDDL(_FOUND).fields])
    rows = _small(benchmark, item_col, item_text_col, settings, block_bytes)
    if rows == []:
        return docs.sparkSession.createDataFrame([], schema)
    if rows is not None:
        return map_batches(plain_names(docs, id_col, text_col), _leaks_in(Items(rows, settings.seed), settings, schema), schema)
    found = _joined(docs.select(F.col(text_col).alias("t")), benchmark.select(F.col(item_text_col).alias("t")), settings)
    named = docs.select(F.col(id_col).alias("doc_id"), F.md5(text_col).alias("f"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.md5(item_text_col).alias("k"))
    return named.join(found, "f").join(items, "k").select(*schema.names)


def _texts_hits(texts: DataFrame, known: StoredHashes, s: Settings) -> DataFrame:
    """Of texts (f, t) with seeds in known: those seeds g and their places at, the words w in them and their places wat."""

    def find(batches):
        for batch in batches:
            for run in W.runs(batch.column(1)):
                w = W.words(run, W.NOT_ALNUM)
                h = W.span_hashes(run, w.start, w.end, lower=True).view(np.int64)
                g, first = W.ngrams(h.view(np.uint64), w.doc, s.seed)
                own, back = np.unique(g.view(np.int64), return_inverse=True)
                hit = np.flatnonzero(known.find(own)[back])
                if not len(hit):
                    continue
                doc, begin = w.doc[first[hit]], np.searchsorted(w.doc, np.arange(len(run)))
                which, lo = np.unique(doc, return_index=True)
                rows = []
                for i, a, b in zip(which.tolist(), lo.tolist(), [*lo[1:].tolist(), len(hit)], strict=True):
                    at = first[hit[a:b]]
                    places = np.unique(at[:, None] + np.arange(s.seed))
                    rows.append((g[hit[a:b]].view(np.int64), at - begin[i], h[places], places - begin[i]))
                if rows:
                    lists = [pa.array(x, type=pa.list_(pa.int64())) for x in zip(*rows, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(run.lo + which)), *lists], names=["f", "g", "at", "w", "wat"])

    return texts.mapInArrow(find, "f string, g array<long>, at array<long>, w array<long>, wat array<long>")


def _items(texts: DataFrame, s: Settings) -> DataFrame:
    """Of texts (k, t): all words iw and all seeds ig, repeats included; texts without a seed give no row."""

    def find(batches):
        for batch in batches:
            for run in W.runs(batch.column(1)):
                w = W.words(run, W.NOT_ALNUM)
                h = W.span_hashes(run, w.start, w.end, lower=True)
                g, first = W.ngrams(h, w.doc, s.seed)
                each = np.arange(len(run) + 1)
                of_words, of_seeds = np.searchsorted(w.doc, each), np.searchsorted(w.doc[first], each)
                some = np.flatnonzero(np.diff(of_seeds))
                lists = [pa.array([x.view(np.int64)[cut[i] : cut[i + 1]] for i in some], type=pa.list_(pa.int64())) for x, cut in ((h, of_words), (g, of_seeds))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(run.lo + some)), *lists], names=["k", "iw", "ig"])

    return texts.mapInArrow(find, "k string, iw array<long>, ig array<long>")


@in_small_batches
def _joined(docs: DataFrame, benchmark: DataFrame, s: Settings) -> DataFrame:
    """Leaks between different texts t of both: MD5 of the document f and of the item k, and the columns of a leak."""
    scratch = Scratch(docs.sparkSession, "tiling")
    kept = scratch.written
    keyed = [F.md5("t").alias("key"), "t"]
    items = kept(_items(benchmark.filter("t IS NOT NULL").distinct().select(*keyed), s), "items")
    seeds = kept(items.select("k", F.size("iw").alias("n"), F.explode("ig").alias("g")).groupBy("k", "n", "g").agg(F.count(F.lit(1)).alias("times")), "seeds")
    known = store_hashes(kept(seeds.select("g").distinct(), "known"), scratch, "sorted")
    hits = kept(_texts_hits(docs.filter("t IS NOT NULL").select(*keyed), known, s).dropDuplicates(["f"]), "hits")
    held = kept(hits.select("f", F.explode(F.array_distinct("g")).alias("g")), "held")
    # shared seeds bound what tiles cover: an item's most frequent ones that stay below the threshold together find nothing
    frequent_first = Window.partitionBy("k").orderBy(F.col("often").desc(), "g").rowsBetween(Window.unboundedPreceding, 0)
    keys = seeds.join(held.groupBy("g").agg(F.count(F.lit(1)).alias("often")), "g").withColumn("upto", s.seed * F.sum("times").over(frequent_first))
    keys = keys.filter(F.col("upto") >= s.threshold * F.col("n")).select("k", "g")
    pairs = kept(held.join(keys, "g").select("f", "k").distinct(), "pairs")
    schema = T.StructType.fromDDL(f"f string, k string, {_FOUND}")

    def judge(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for r, (g, at, w, wat, pattern, ig) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True)):
                times = Counter(ig)
                if s.seed * sum(times[x] for x in set(g)) < s.threshold * len(pattern):
                    continue
                places = sorted({x for a, y in zip(at, g, strict=True) if y in times for x in range(a, a + s.seed)})
                word = dict(zip(wat, w, strict=True))
                laid = tiles(pattern, [word[x] for x in places], places, s.min_tile, s.first_search)
                covered = sum(n for _, _, n in laid)
                if covered and covered >= s.threshold * len(pattern):
                    own = [{"item_start": p, "doc_start": places[t], "n_words": n} for p, t, n in laid]
                    rows.append((r, len(pattern), covered, covered / len(pattern), own))
            if rows:
                which, *rest = zip(*rows, strict=True)
                names = [batch.column(i).take(pa.array(which)).cast(types.field(i).type) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*names, *[pa.array(x, type=types.field(i + 2).type) for i, x in enumerate(rest)]], schema=types)

    both = pairs.join(hits, "f").join(items, "k").select("f", "k", "g", "at", "w", "wat", "iw", "ig")
    out = written(both.mapInArrow(judge, schema), "tiling-leaks")
    scratch.clear()
    return out


def _leaks_in(items: Items, s: Settings, schema: T.StructType):
    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        found = list(_found(batch.column(1), items, s))
        if found:
            columns = [
                batch.column(0).take(pa.array([r for r, *_ in found])).cast(types.field(0).type),
                pa.array([items.ids[i] for _, i, *_ in found], type=types.field(1).type),
                pa.array([len(items.words[i]) for _, i, *_ in found], type=pa.int64()),
                pa.array([c for *_, c in found], type=pa.int64()),
                pa.array([c / len(items.words[i]) for _, i, _, c in found], type=pa.float64()),
                pa.array([[{"item_start": p, "doc_start": t, "n_words": n} for p, t, n in laid] for _, _, laid, _ in found], type=types.field(5).type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=types)

    return find


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", settings: Settings = Settings(), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    rows = _small(benchmark, item_col, item_text_col, settings, block_bytes)
    if rows == []:
        return docs
    if rows is not None:
        return map_batches(docs, _clean_of(Items(rows, settings.seed), settings, docs.columns.index(text_col)), docs.schema)
    found = _joined(docs.select(F.col(text_col).alias("t")), benchmark.select(F.col(item_text_col).alias("t")), settings)
    return docs.join(found.select(F.col("f").alias("__leaked")).distinct(), F.md5(text_col) == F.col("__leaked"), "left_anti")


def _clean_of(items: Items, s: Settings, place: int):
    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        good = np.ones(batch.num_rows, dtype=bool)
        good[[r for r, *_ in _found(batch.column(place), items, s)]] = False
        yield batch.filter(pa.array(good))

    return keep
