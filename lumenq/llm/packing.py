"""Token ids as Arrow files of equal-length sequences.

Each file is an Arrow IPC file whose record batches all hold the same number of sequences (only the last may be
shorter): fixed-size lists of ids, of mask bits (1: a token, 0: padding) and of document ends. Sequence k is row
k % rows of batch k // rows, so a reader maps the file and takes any sequence without copying or scanning. Beside it
lies an index file: document id, first token and number of tokens of every document of the file. Files follow each
other in ascending document order, and a document's global start is the tokens of the earlier files plus its own.

Every document's ids are followed by an end id. Ids take two bytes each, four where the vocabulary needs them.

Encoding goes through a table of pieces: a text is cut before a space, and around a line feed, that stands alone between
two characters that are no white space. The tokenizer never joins characters across such a place, so ids of the pieces,
put together, are the ids of the text; each distinct piece is encoded once while there is room for it in the table, and once a batch beyond that.

Files are ranges of ids. Their borders come from the ids alone, before any text is encoded, so that it is encoded once.

Defined results: a null or empty text is its end id alone; a null id comes first; repeated rows are documents of
their own; an empty table gives no files and an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm.columns import shared_path, written
from lumenq.llm.store import local_path, new_file


@dataclass(frozen=True)
class Settings:
    """length: tokens of a sequence. rows: sequences of a batch. pieces: most pieces that a worker keeps."""

    length: int = 1024
    rows: int = 128
    pieces: int = 800_000
    end_id: int = 0


#: All white space but the space and the line feed.
_OTHER = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
#: Characters that only Python counts as white space make a cut less, never more.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: What a text must not have, for each space and line feed in it to stand alone.
_DOUBLE = ["  ", "\n\n", " \n", "\n "]


class Encoder:
    """Ids of texts as bytes, through a bounded table of pieces. Its keys: a word for a space and that word, a line feed and a piece for the piece as it is."""

    def __init__(self, tokenizer_path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.begins = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
        self.begins[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if t.startswith("\u0120")]] = True  # how byte-level tokenizers write a space
        self.known: dict[str, bytes] = {}
        self.most = most

    @staticmethod
    def keys(text: str) -> list[str]:
        if text[0].isspace() or text[-1].isspace() or any(c in text for c in _OTHER) or any(x in text for x in _DOUBLE):
            return ["\n" + x for x in _CUT.split(text)]
        out: list[str] = []
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = "\n" + words[0]
            out += words
            out.append("\n\n")
        out.pop()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        get, cut, missing = self.known.get, [], set()
        for t in texts:
            keys = self.keys(t) if t else []
            ids = list(map(get, keys))
            gaps = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            missing.update([keys[i] for i in gaps])
            cut.append((keys, ids, gaps))
        fresh = self._encode_keys(missing)
        if len(self.known) < self.most:
            self.known.update(fresh)  # words that come first are mostly frequent ones; when full, the table stays as it is
        for keys, ids, gaps in cut:
            for i in gaps:
                ids[i] = fresh[keys[i]]
        return [b"".join(ids) for _, ids, _ in cut]

    def _encode_keys(self, keys: set[str]) -> dict[str, bytes]:
        """Words with their spaces are encoded as one text, which is faster; its ids are cut where a token begins with the space."""
        out: dict[str, bytes] = {}
        plain = [k for k in keys if k[0] != "\n"]
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            heads = np.flatnonzero(self.begins[ids])
            if len(heads) != len(some):
                raise AssertionError("a piece has lost its space")
            raw, size = ids.tobytes(), self.dtype().itemsize
            cuts = [*(heads * size).tolist(), len(raw)]
            out.update(zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))
        rest = [k for k in keys if k[0] == "\n"]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([k[1:] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, dtype=self.dtype).tobytes()
        return out


@lru_cache(maxsize=1)
def _encoder(tokenizer_path: str, most: int) -> Encoder:
    """A worker keeps its encoder, and so its table, from task to task."""
    return Encoder(tokenizer_path, most)


def _borders(docs: DataFrame, id_col: str, parts: int) -> list:
    """The smallest id of each range but the first, for at most so many ranges of nearly equal counts; equal ids are in one range, null in the first."""
    ids = docs.select(F.col(id_col).alias("id")).filter(F.col(id_col).isNotNull())
    ranges = ids.repartitionByRange(parts, "id").groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("least"))
    return sorted(r["least"] for r in ranges.collect())[1:]  # a row for each range


def _encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, borders: list, s: Settings) -> DataFrame:
    """part, id and its ids, compressed for the shuffle."""
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType())])

    def encode(batches):
        encoder, press = _encoder(tokenizer_path, s.pieces), zstandard.ZstdCompressor(level=1)
        end = np.array([s.end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                blobs = [press.compress(x + end) for x in encoder.encode([t or "" for t in part.column(1).to_pylist()])]
                ranges = [0 if x is None else bisect_right(borders, x) for x in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(ranges, type=pa.int32()), part.column(0), pa.array(blobs, type=pa.binary())], names=["part", "id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(encode, schema)


def _sequences(values: np.ndarray, mask: np.ndarray, ends: np.ndarray, length: int) -> pa.RecordBatch:
    arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (values, mask, ends)]
    return pa.RecordBatch.from_arrays(arrays, names=["ids", "mask", "ends"])


class _Writer:
    """One pair of files, written batch by batch."""

    def __init__(self, out, dtype, s: Settings):
        self.s, self.dtype = s, dtype
        kinds = [pa.from_numpy_dtype(dtype), pa.bool_(), pa.bool_()]
        self.file = pa.ipc.new_file(out, pa.schema([(n, pa.list_(k, s.length)) for n, k in zip(("ids", "mask", "ends"), kinds, strict=True)]))
        self.full = s.length * s.rows
        self.waiting: list[np.ndarray] = []
        self.stops: list[int] = []  # places of document ends among the waiting tokens
        self.size = self.tokens = 0

    def add(self, ids: np.ndarray) -> int:
        """Returns the document's first token."""
        first = self.tokens
        self.waiting.append(ids)
        self.size += len(ids)
        self.tokens += len(ids)
        self.stops.append(self.size - 1)
        if self.size >= self.full:
            self.flush(self.size // self.full * self.full)
        return first

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, dtype=self.dtype)
        ends = np.zeros(len(ids), dtype=bool)
        ends[self.stops] = True
        for at in range(0, n, self.full):
            part = slice(at, min(at + self.full, n))
            some, stop = ids[part], ends[part]
            pad = -len(some) % self.s.length
            mask = np.arange(len(some) + pad) < len(some)
            self.file.write_batch(_sequences(np.pad(some, (0, pad)), mask, np.pad(stop, (0, pad)), self.s.length))
        self.waiting, self.size = [ids[n:]], len(ids) - n
        self.stops = [x - n for x in self.stops if x >= n]

    def close(self) -> None:
        self.flush(self.size)
        self.file.close()


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Write all documents below path, in ascending id order; returns the list of files: file, part, n_docs, n_tokens and start, the tokens before the file."""
    s = settings
    borders = _borders(docs, id_col, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = _encoded(docs, id_col, text_col, tokenizer_path, borders, s).repartitionById(len(borders) + 1, "part")
    ids = dealt.sortWithinPartitions(F.col("id").asc_nulls_first()).select("id", "ids")

    def pack(batches):
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        part, press = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        from tokenizers import Tokenizer

        wide = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) > 1 << 16
        dtype = np.uint32 if wide else np.uint16
        name, docs_seen = f"{path}/part-{part:06d}", 0
        index_schema = pa.schema([("doc_id", head.schema.field(0).type), ("first", pa.int64()), ("n_tokens", pa.int64())])
        with new_file(f"{name}.arrow") as out, new_file(f"{name}.docs.arrow") as index_out:
            writer, index = _Writer(out, dtype, s), pa.ipc.new_file(index_out, index_schema)
            for batch in _with(head, batches):
                first, sizes = [], []
                for blob in batch.column(1):
                    tokens = np.frombuffer(press.decompress(blob.as_buffer()), dtype=dtype)
                    first.append(writer.add(tokens))
                    sizes.append(len(tokens))
                index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, type=pa.int64()), pa.array(sizes, type=pa.int64())], schema=index_schema))
                docs_seen += batch.num_rows
            writer.close()
            index.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], type=pa.int64()), pa.array([docs_seen]), pa.array([writer.tokens])], names=["file", "part", "n_docs", "n_tokens"])

    files = written(ids.mapInArrow(pack, "file string, part long, n_docs long, n_tokens long"), "packed-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _with(head: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield head
    yield from rest


class Reader:
    """Random access to a file's sequences and documents; on a mounted store everything is mapped."""

    def __init__(self, name: str):
        self.file, self.index = (_open(f"{name}{end}") for end in (".arrow", ".docs.arrow"))
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids without a copy, and the mask."""
        batch, row = self.file.get_batch(k // self.rows), k % self.rows
        ids = batch.column(0).values.to_numpy()[row * self.length : (row + 1) * self.length]
        return ids, batch.column(1).values.slice(row * self.length, self.length).to_numpy(zero_copy_only=False)

    def tokens(self, first: int, n: int) -> np.ndarray:
        """n ids in a row, across sequences and batches."""
        per, out = self.length * self.rows, []
        while n > 0:
            values = self.file.get_batch(first // per).column(0).values.to_numpy()
            some = values[first % per : first % per + n]
            out.append(some)
            first, n = first + len(some), n - len(some)
        return out[0] if len(out) == 1 else np.concatenate(out)

    def documents(self) -> Iterator[pa.RecordBatch]:
        for i in range(self.index.num_record_batches):
            yield self.index.get_batch(i)


def _open(uri: str) -> pa.ipc.RecordBatchFileReader:
    if (path := local_path(uri)) is not None:
        return pa.ipc.open_file(pa.memory_map(path))
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    return pa.ipc.open_file(store.open_input_file(at))


def digest(files: DataFrame, id_type: T.DataType) -> DataFrame:
    """Read the files back: id, start, n_tokens and the CRC-32 of each document's ids as 32-bit integers."""
    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("start long, n_tokens long, ids_crc32 long, part long").fields])

    def read(batches):
        for batch in batches:
            for name, part, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                reader = Reader(name)
                for docs in reader.documents():
                    first, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crc = [zlib.crc32(reader.tokens(f, k).astype("<u4").tobytes()) for f, k in zip(first.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(first + start), docs.column(2), pa.array(crc, type=pa.int64()), pa.array(np.full(len(n), part))], names=[f.name for f in schema])

    count = files.count()  # one row for each file
    dealt = written(files.select("file", "part", "start"), "packed-starts").repartition(max(1, count))
    return dealt.mapInArrow(read, schema)


def pack_and_digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    files = write(docs, shared_path(docs.sparkSession, "packed"), tokenizer_path, id_col, text_col, settings)
    return digest(files, docs.schema[id_col].dataType)


__all__ = ["Encoder", "Reader", "Settings", "digest", "pack_and_digest", "write"]
