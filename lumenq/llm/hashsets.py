"""Sets of 64-bit hashes that are too large for a closure: sorted arrays in the shared store, by range, which workers map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.llm.columns import Scratch
from lumenq.llm.store import get_array, put_array

#: Hashes of a range, about.
RANGE = 2_000_000


class StoredHashes:
    """Membership in a set that store_hashes wrote."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits
        self.parts: dict[int, np.ndarray] = {}

    def part(self, k: int) -> np.ndarray:
        if k not in self.parts:
            try:
                self.parts[k] = get_array(f"{self.path}/{k}", np.int64)
            except FileNotFoundError:  # none in this range
                self.parts[k] = np.zeros(0, dtype=np.int64)
        return self.parts[k]

    def find(self, own: np.ndarray) -> np.ndarray:
        """Which of own, which is sorted, are in the set."""
        out = np.zeros(len(own), dtype=bool)
        edges = [0, *np.searchsorted(own, (np.arange(1, 1 << self.bits) - (1 << (self.bits - 1))) << (64 - self.bits)).tolist(), len(own)] if self.bits else [0, len(own)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            there = self.part(k) if b > a else own[:0]
            if len(there):
                at = np.minimum(np.searchsorted(there, own[a:b]), len(there) - 1)
                out[a:b] = there[at] == own[a:b]
        return out

    def holds(self, own: np.ndarray) -> np.ndarray:
        """find for hashes in any order."""
        order = np.argsort(own)
        out = np.empty(len(own), dtype=bool)
        out[order] = self.find(own[order])
        return out


def store_hashes(found: DataFrame, scratch: Scratch, name: str) -> StoredHashes:
    """The column g of a written table of distinct hashes, stored below scratch."""
    bits = (found.count() // RANGE).bit_length()
    where = StoredHashes(f"{scratch.root}/{name}", bits)
    shard = F.shiftright("g", 64 - bits) + (1 << (bits - 1)) if bits else F.lit(0)

    def write(batches):
        parts: dict[int, list] = {}
        for b in batches:
            k, g = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for x in np.unique(k):
                parts.setdefault(int(x), []).append(g[k == x])
        for k, own in parts.items():
            put_array(f"{where.path}/{k}", np.sort(np.concatenate(own)))
            yield pa.RecordBatch.from_arrays([pa.array([k])], names=["k"])

    scratch.written(found.select(shard.cast("long").alias("k"), "g").repartition(1 << bits, "k").mapInArrow(write, "k long"), f"{name}-ranges")
    return where
