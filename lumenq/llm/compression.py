"""Quality rules by compression bands.

Whole documents and fixed chunks are compressed with zstandard. Prose compresses into a known band for its length;
below it a text repeats itself, above it it is random. Limits depend on the length, as short texts compress less.

Defined results: a null or empty text has no words, fails the base rules and has no ratios; texts shorter than the
first band's least size are judged by the base rules alone; equal rows get equal verdicts; an empty table gives an
empty result. Further columns of the input are ignored by scores() and passed through by kept().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lumenq.llm import wordscan as W
from lumenq.llm.columns import id_schema, map_batches, plain_names

#: Characters that count as symbols: [#*$%&|<>]
_SYMBOL = W._bytes_of("#*$%&|<>")
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


@dataclass(frozen=True)
class Band:
    """From so many bytes on, compressed size / size must lie between low and high, and, where many bytes are digits, that over the entropy of single bytes below over: random digits, such as hexadecimal ones, compress, but never below that."""

    from_bytes: int
    low: float
    high: float
    over: float = float("inf")


@dataclass(frozen=True)
class Rules:
    """whole: bands by document length. chunk: bytes of a chunk, its low and high, and the share of chunks outside that rejects."""

    whole: tuple[Band, ...] = (
        Band(96, 0.0, 0.96),
        Band(192, 0.0, 0.89),
        Band(256, 0.22, 0.82),
        Band(384, 0.22, 0.77),
        Band(512, 0.22, 0.74),
        Band(768, 0.22, 0.70),
        Band(1024, 0.18, 0.66),
        Band(2048, 0.18, 0.62, 1.045),
        Band(4096, 0.15, 0.58, 1.01),
        Band(8192, 0.15, 0.56, 0.99),
    )
    chunk_bytes: int = 1024
    chunk_low: float = 0.15
    chunk_high: float = 0.68
    chunk_share: float = 0.25
    level: int = 3
    least_words: int = 20
    repeat_window: int = 8
    most_repeat_percent: int = 30

    def band(self, size: int) -> Band | None:
        fits = [b for b in self.whole if b.from_bytes <= size]
        return max(fits, key=lambda b: b.from_bytes) if fits else None


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, low_chunks long, high_chunks long, n_chunks long, reason string"


def base_counts(run: W.Run, window: int) -> tuple[np.ndarray, ...]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows: one number for each text."""
    n = len(run)
    w = W.words(run)
    n_words = np.bincount(w.doc, minlength=n)
    chars = run.per_text(~W.BLANK[run.buf] & ~_CONTINUES[run.buf])
    symbols = run.per_text(_SYMBOL[run.buf])
    # lines: from a text's start or after a line feed, to a line feed or the text's end
    feeds = np.flatnonzero(run.buf == 10)
    start = np.concatenate([run.offsets[:-1], feeds + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(run.offsets, feeds, side="right") - 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.empty_like(start)
    if len(start):
        end[:-1] = np.where(doc[1:] == doc[:-1], start[1:] - 1, run.offsets[doc[:-1] + 1])
        end[-1] = run.offsets[-1]
    begun = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    full = begun[1] > begun[0]
    start, end, doc = start[full], end[full], doc[full]
    key = W.mix(W.span_hashes(run, start, end) ^ W.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    dup_lines = np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)
    # words in windows that the text has twice or more
    repeat = np.zeros(n, dtype=np.int64)
    g, at = W.ngrams(W.span_hashes(run, w.start, w.end), w.doc, window)
    if len(g):
        key = W.mix(g ^ W.mix(w.doc[at].astype(np.uint64) + np.uint64(1)))
        ranked = np.sort(key)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if len(twice):
            at = at[np.isin(key, twice)]
            steps = np.bincount(at, minlength=len(w.doc) + 1) - np.bincount(at + window, minlength=len(w.doc) + 1)
            repeat = np.bincount(w.doc[np.cumsum(steps)[: len(w.doc)] > 0], minlength=n)
    return n_words, chars, symbols, dup_lines, repeat


#: Share of digits from which a text is compared with the entropy of its bytes.
DIGITS = 0.2


def _random_digits(text: bytes, ratio: float, over: float) -> bool:
    """Whether a text of many digits compresses no better than its bytes, each by itself, would."""
    n = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    if n[48:58].sum() < DIGITS * len(text):
        return False
    p = n[n > 0] / len(text)
    return bool(ratio > over * -(p * np.log2(p)).sum() / 8)


def _verdict(text: bytes, rules: Rules, press: zstandard.ZstdCompressor) -> tuple:
    """ratio, chunks below and above their limits, chunks, reason or None."""
    size = len(text)
    band = rules.band(size)
    if size == 0:
        return None, 0, 0, 0, None
    ratio = len(press.compress(text)) / size
    pieces = [text[i : i + rules.chunk_bytes] for i in range(0, size, rules.chunk_bytes)]
    if len(pieces[-1]) < rules.chunk_bytes:
        pieces.pop()  # a short rest says nothing by itself: the last chunk is taken from the end
        if pieces:
            pieces.append(text[-rules.chunk_bytes :])
    ratios = [len(press.compress(p)) / len(p) for p in pieces]
    low, high = sum(r < rules.chunk_low for r in ratios), sum(r > rules.chunk_high for r in ratios)
    reason = None
    if band is not None and ratio < band.low:
        reason = "repetitive"
    elif band is not None and (ratio > band.high or _random_digits(text, ratio, band.over)):
        reason = "incompressible"
    elif ratios and low >= rules.chunk_share * len(ratios):
        reason = "repetitive chunks"
    elif ratios and high >= rules.chunk_share * len(ratios):
        reason = "incompressible chunks"
    return ratio, low, high, len(ratios), reason


def _judge(column: pa.Array, rules: Rules) -> dict[str, list]:
    press = zstandard.ZstdCompressor(level=rules.level)
    out: dict[str, list] = {c.split()[0]: [] for c in _COLUMNS.split(", ")}
    for run in W.runs(column):
        counts = base_counts(run, rules.repeat_window)
        failed = (counts[0] < rules.least_words) | (100 * counts[4] > rules.most_repeat_percent * counts[0])
        verdicts = [_verdict(run.text(i), rules, press) for i in range(len(run))]
        for name, values in zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), (*counts, failed), strict=True):
            out[name] += values.tolist()
        ratio, low, high, chunks, reason = zip(*verdicts, strict=True)
        out["ratio"] += ratio
        out["low_chunks"] += low
        out["high_chunks"] += high
        out["n_chunks"] += chunks
        out["reason"] += ["base" if f else r for f, r in zip(failed, reason, strict=True)]
        out["kept"] += [not f and r is None for f, r in zip(failed, reason, strict=True)]
    return out


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row for each document: id, the base counts, the verdict, and the ratios behind it."""
    schema = id_schema(docs, id_col, _COLUMNS)

    def judge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        found = _judge(batch.column(1), rules)
        types = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(types.field(0).type), *[pa.array(found[f.name], type=f.type) for f in list(types)[1:]]], schema=types)

    return map_batches(plain_names(docs, id_col, text_col), judge, schema)


def kept(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns."""
    place = docs.columns.index(text_col)

    def keep(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(_judge(batch.column(place), rules)["kept"], type=pa.bool_()))

    return map_batches(docs, keep, docs.schema)
