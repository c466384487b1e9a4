"""Sharding by minimax contiguous partition, in DataFrame operations only.

Groups of equal texts are atoms, in the order of their SHA-256. The smallest capacity with which a greedy pass, that
fills one shard after the other, needs no more than the given shards is found by binary search; the cuts are where
that pass makes them. Size: UTF-8 bytes plus 1.

The search runs on a sparse list of running totals, at most POINTS at a time. Between two known totals the pass is
bounded from both sides; the intervals in which the bounds differ are looked up in finer steps, until the smallest
capacity and its cuts are exact. So no more than POINTS numbers ever reach the driver, however many groups there are.

Defined results: a null text has size 1 and the checksum of an empty text, and goes with the empty texts' group apart
(null is a text of its own); repeated rows are rows of their own; equal texts have neighbouring slots, in order of their
ids (null last), or in a group of more than LARGE_GROUP rows in order of parts by a hash of the id and within them of
ids; equal ids are interchangeable; with fewer groups than shards the last shards stay
empty; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenq.llm.columns import written

POINTS = 16384
#: Rows of a group beyond which its rows are numbered in parts.
LARGE_GROUP = 10_000
PARTS = 1024


class Totals:
    """Known running totals, sorted; open[i]: there are unknown ones between total i - 1 and total i."""

    def __init__(self, ends: list[int], open_: list[bool]):
        self.ends, self.open = [0, *ends], [False, *open_]

    def floor(self, x: int, high: bool) -> int:
        """The largest total up to x: exact, or its lower or upper bound."""
        i = bisect_right(self.ends, x) - 1
        if high and i + 1 < len(self.ends) and self.open[i + 1]:
            return x
        return self.ends[i]

    def cuts(self, capacity: int, shards: int, high: bool = False) -> list[int]:
        """Where a greedy pass ends each shard."""
        out, at = [], 0
        for _ in range(shards):
            at = self.floor(at + capacity, high)
            out.append(at)
        return out

    def least(self, shards: int, high: bool) -> int:
        """The smallest capacity that suffices, by the lower or the upper bound of the pass."""
        lo, hi = 0, self.ends[-1]
        while lo < hi:
            mid = (lo + hi) // 2
            if self.cuts(mid, shards, high)[-1] >= self.ends[-1]:
                hi = mid
            else:
                lo = mid + 1
        return lo


def capacity_and_cuts(groups: DataFrame, shards: int, points: int = POINTS) -> tuple[int, list[int]]:
    """groups: one row for each atom with end, its running total. Each step is one aggregation over the open intervals."""
    whole = groups.agg(F.max("end").alias("m")).first()["m"] or 0
    known = Totals([whole], [True]) if whole else Totals([], [])
    while True:
        least, most = known.least(shards, True), known.least(shards, False)
        low, high = known.cuts(least, shards), known.cuts(most, shards, True)
        spans = []
        for a, b in zip(low, high, strict=True):
            i, j = bisect_right(known.ends, a) - 1, bisect_right(known.ends, b)
            spans += [k for k in range(max(1, i), min(j, len(known.ends) - 1) + 1) if known.open[k]]
        spans = sorted(set(spans))
        if not spans:
            return most, known.cuts(most, shards)
        known = _finer(groups, known, spans, points)


def _finer(groups: DataFrame, known: Totals, spans: list[int], points: int) -> Totals:
    """Split the ranges of neighbouring open intervals into equal steps and learn the first and the last total of each step. The first of a range becomes known, so every pass narrows it, wherever its totals lie."""
    ranges = merged(known, spans)
    cell, inside = F.lit(None).cast("struct<lo: long, step: long>"), F.lit(False)
    for lo, hi in ranges:
        here = (F.col("end") > lo) & (F.col("end") <= hi)
        width = -(-(hi - lo) // max(2, points // len(ranges)))
        cell = F.when(here, F.struct(F.lit(lo).cast("long").alias("lo"), F.floor((F.col("end") - lo - 1) / F.lit(width)).cast("long").alias("step"))).otherwise(cell)
        inside |= here
    found = groups.filter(inside).groupBy(cell.alias("cell")).agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("n")).collect()
    return learnt(known, [(r["first"], r["last"], r["n"]) for r in found])


#: Ranges of one pass: each is a term of the filter, so their number is bounded; the rest waits for the next pass.
MOST_RANGES = 64


def merged(known: Totals, spans: list[int]) -> list[tuple[int, int]]:
    """Neighbouring open intervals as one range."""
    out: list[list[int]] = []
    for k in spans:
        lo, hi = known.ends[k - 1], known.ends[k]
        if out and out[-1][1] == lo:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out[:MOST_RANGES]]


def learnt(known: Totals, steps: list[tuple[int, int, int]]) -> Totals:
    """known with the first and last total and the number of totals of each step."""
    table = dict(zip(known.ends[1:], known.open[1:], strict=True))
    for first, last, n in steps:
        i, j = bisect_right(known.ends, first - 1), bisect_right(known.ends, last)
        own = sorted({first, last, *known.ends[i:j]})
        for before, end in zip([None, *own], own, strict=False):
            was = table.get(end, True)  # what was closed stays so; nothing lies between steps, or where all are known
            table[end] = before is not None and n > len(own) and was
    ends = sorted(table)
    return Totals(ends, [table[e] for e in ends])


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, size, text_crc32, shard and slot (its place in the shard, from 0)."""
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.unhex(F.sha2(text.cast("binary"), 256))).otherwise(F.lit(b"")).alias("atom"),
    )
    rows = written(rows, "shard-rows")
    groups = rows.groupBy("atom").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.withColumn("b", F.coalesce(F.conv(F.substring(F.hex("atom"), 1, 3), 16, 10).cast("int"), F.lit(0))), "shard-groups")
    # running totals in two steps: over 4096 buckets of the order, then within each
    buckets = groups.groupBy("b").agg(F.sum("bytes").alias("bb"), F.sum("n").alias("bn"))
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("b", F.coalesce(F.sum("bb").over(earlier), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("n0"))
    upto = Window.partitionBy("b").orderBy("atom")
    groups = groups.join(buckets, "b")
    groups = groups.select("atom", "n", (F.col("bytes0") + F.sum("bytes").over(upto)).alias("end"), (F.col("n0") + F.sum("n").over(upto) - F.col("n")).alias("first"))
    groups = written(groups, "shard-totals")
    _, cuts = capacity_and_cuts(groups, shards)
    groups = placed(groups, cuts)
    starts = groups.groupBy("shard").agg(F.min("first").alias("start"))  # a row for each shard at most
    groups = groups.join(F.broadcast(starts), "shard").select("atom", "n", "shard", (F.col("first") - F.col("start")).alias("first"))
    rows = rows.join(groups, "atom")
    # numbers within a group; a large group is numbered in parts, whose sizes give each part's first number
    rows = rows.withColumn("part", F.when(F.col("n") > LARGE_GROUP, F.pmod(F.xxhash64("id"), F.lit(PARTS))).otherwise(F.lit(0)).cast("int"))
    large = rows.filter(F.col("n") > LARGE_GROUP).groupBy("atom", "part").agg(F.count(F.lit(1)).alias("pn"))
    ahead = Window.partitionBy("atom").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    large = large.select(F.col("atom").alias("a"), F.col("part").alias("p"), F.coalesce(F.sum("pn").over(ahead), F.lit(0)).alias("offset"))
    # dealt by group and part, or the join's dealing by group alone would do for the window and leave a large group in one task
    rows = rows.repartition("atom", "part")
    number = F.row_number().over(Window.partitionBy("atom", "part").orderBy(F.col("id").asc_nulls_last())) - 1
    rows = rows.withColumn("number", number).join(large, (F.col("atom") == F.col("a")) & (F.col("part") == F.col("p")), "left")
    slot = F.col("first") + F.coalesce("offset", F.lit(0)) + F.col("number")
    return rows.select("id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def placed(groups: DataFrame, cuts: list[int]) -> DataFrame:
    """groups with shard, how many cuts but the last lie before a group's end. The cuts are one table of a row for each cell of equal width, which holds the shard that begins it and the cuts within, so neither the plan nor the work for a row grows with the shards."""
    cells = 4 * len(cuts)
    width = max(1, -(-max(cuts, default=1) // cells))
    table: dict[int, list[int]] = {}
    for cut in cuts[:-1]:
        table.setdefault(cut // width, []).append(cut)
    rows, before = [], 0
    for cell in range(cells + 1):
        own = table.get(cell, [])
        rows.append({"cell": cell, "before": before, "cuts": own})
        before += len(own)
    schema = "array<struct<cell: long, before: int, cuts: array<long>>>"
    lookup = groups.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("c")).select("c.*")
    out = groups.withColumn("cell", F.floor(F.col("end") / F.lit(width)).cast("long")).join(F.broadcast(lookup), "cell")
    return out.withColumn("shard", F.col("before") + F.size(F.filter("cuts", lambda c: c < F.col("end")))).drop("cell", "before", "cuts")
