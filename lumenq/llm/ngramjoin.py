"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word n-grams, as 64-bit hashes in one global order: n-grams that many documents
have come last, others by hash. Two sets with a Jaccard index of at least t must share an element among their first
n - ceil(t n) + 1, their prefixes. So:

1. N-grams that many documents have near the head of their order are counted over all documents, then, in documents
   that have such ones, those that take their places; the frequent ones are put last, or else a common passage would
   make candidates of all documents that have it. Which n-grams these are bears on speed alone, never on the links.
2. Equal sets are one class, named by its smallest document id; classes of equal prefix and size are one group.
3. Every group is paired with one group of nearly its size under each prefix n-gram, the one with most frequent n-grams
   (a star, so a large family of copies costs one pair each), every class with the first of its group. Pairs that pass the size and
   prefix bounds are verified on their whole sets; connected components join what is linked.
4. Groups are split by component. What is still apart and shares a prefix n-gram is paired in full, bounded, expanded
   to classes and verified; then components are joined once more. Pairs within one component need no check, so the
   components are those of all links, and no family is expanded into all its pairs.

Texts with fewer words than n count as one n-gram. Defined results: null, empty and blank texts have an empty set and
are linked with nothing; a null id gets its size, and a null component, as no link can name it; equal rows get equal
results; one id with several texts is one document, linked with what any of its texts is; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenq.llm import wordscan as W
from lumenq.llm.columns import Scratch, in_small_batches
from lumenq.llm.columns import written as _kept
from lumenq.llm.graph import components
from lumenq.llm.hashsets import StoredHashes, store_hashes


@dataclass(frozen=True)
class Settings:
    """words: of an n-gram. percent: least Jaccard index. frequent: documents beyond which an n-gram is put last."""

    words: int = 5
    percent: int = 80
    frequent: int = 32


def prefix_size(n, percent: int):
    """n - ceil(percent / 100 * n) + 1, for numbers and numpy arrays."""
    return n - (percent * n + 99) // 100 + 1


def _sets(column: pa.Array, words: int):
    """The sorted distinct hashes of each text in turn."""
    for run in W.runs(column):
        w = W.words(run)
        h = W.span_hashes(run, w.start, w.end, lower=True)
        g, first = W.ngrams(h, w.doc, words)
        g = g.view(np.int64)
        of = w.doc[first]
        cut = np.searchsorted(of, np.arange(len(run) + 1))
        at = np.searchsorted(w.doc, np.arange(len(run) + 1))
        for i in range(len(run)):
            if at[i + 1] - at[i] >= words:
                own = np.sort(g[cut[i] : cut[i + 1]])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif at[i + 1] > at[i]:
                yield np.array([W.ngram_hash(h[at[i] : at[i + 1]])], dtype=np.uint64).view(np.int64)
            else:
                yield np.zeros(0, dtype=np.int64)


def _head(n: int, s: Settings) -> int:
    """A prefix and half of one more: where frequent n-grams are looked for first."""
    k = prefix_size(n, s.percent)
    return k + k // 2 + 8


def _frequent(texts: DataFrame, s: Settings, known: StoredHashes | None = None) -> DataFrame:
    """n-grams that more than s.frequent documents have in their heads, or, with known, in what takes the place of known ones there.

    A document whose head holds a share p of known n-grams is read 1 / (1 - p) times as far, so that as many others are
    found as a head has; where all are known it is read whole.
    """

    def wanted(own: np.ndarray) -> np.ndarray:
        head = own[: _head(len(own), s)]
        if known is None or not len(own):
            return head
        there = known.find(head)
        other = len(head) - int(there.sum())
        if other == len(head):
            return head[:0]
        far = own[: -(-len(head) * len(head) // other)] if other else own
        return far[~known.find(far)]

    def count(batches):
        for batch in batches:
            parts, size = [], 0
            for own in _sets(batch.column(0), s.words):
                parts.append(wanted(own))
                size += len(parts[-1])
                if size > 500_000:
                    yield counted(parts)
                    parts, size = [], 0
            if size:
                yield counted(parts)

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["g", "n"])

    counts = texts.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") > s.frequent).select("g")


def _mixed_sums(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    u = own.view(np.uint64)
    return tuple(int(W.mix(u ^ np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64)) for seed in (0x1B873593CC9E2D51, 0x52DCE729E6546B64))


def _documents(docs: DataFrame, s: Settings, last: StoredHashes) -> DataFrame:
    """id, set size n, set fingerprint (f1, f2), share of frequent n-grams, prefix in the global order and its fingerprint (p1, p2)."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), *T.StructType.fromDDL("n long, f1 long, f2 long, common double, prefix array<long>, p1 long, p2 long").fields])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def describe(batches):
        for batch in batches:
            rows = []
            for own in _sets(batch.column(1), s.words):
                if not len(own):
                    rows.append((0, 0, 0, 0.0, [], 0, 0))
                    continue
                late = last.find(own)
                prefix = np.concatenate([own[~late], own[late]])[: prefix_size(len(own), s.percent)]
                rows.append((len(own), *_mixed_sums(own), float(late.mean()), prefix, *_mixed_sums(prefix)))
            if rows:
                arrays = [batch.column(0), *[pa.array(x, type=k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return docs.select("id", "t").mapInArrow(describe, schema)


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Two sets of these sizes that are similar enough share at least so many: 100 i >= percent (a + b - i)."""
    return F.ceil((a + b) * percent / (100.0 + percent) - 1e-6)


def _can_meet(n1: str, at1: str, n2: str, at2: str, s: Settings) -> Column:
    """Two sets of these sizes that share an n-gram at these places, as their first: what follows must still suffice."""
    n1, at1, n2, at2 = (F.col(x) for x in (n1, at1, n2, at2))
    least = _least_overlap(n1, n2, s.percent)
    return _sizes_fit(n1, n2, s.percent) & (n1 - at1 >= least) & (n2 - at2 >= least)


def _bounded(pairs: DataFrame, groups: DataFrame, s: Settings) -> DataFrame:
    """Group pairs (a, b) that can still be similar: beyond their prefixes they share at most the longer rest, within them what the prefixes share."""
    one = groups.select(F.col("gid").alias("a"), F.col("n").alias("an"), F.col("prefix").alias("ap"))
    two = groups.select(F.col("gid").alias("b"), F.col("n").alias("bn"), F.col("prefix").alias("bp"))
    rows = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("ap", "bp"))
    rest = F.greatest(F.col("an") - F.size("ap"), F.col("bn") - F.size("bp"))
    return rows.filter(common + rest >= _least_overlap(F.col("an"), F.col("bn"), s.percent)).select(*pairs.columns)


def _verified(pairs: DataFrame, docs: DataFrame, s: Settings, scratch: Scratch, name: str) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets are similar enough."""
    pairs = scratch.written(pairs.distinct(), f"{name}-pairs")
    wanted = scratch.written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), f"{name}-wanted")
    schema = T.StructType([docs.schema["id"], T.StructField("s", T.BinaryType())])
    # texts are picked by their ids' hashes where they are read; a set too many would find no pair
    hashes = scratch.written(wanted.select(F.xxhash64("id").alias("g")).distinct(), f"{name}-hashes")
    picked = store_hashes(hashes, scratch, f"{name}-hashes-sorted")

    def build(batches):
        for batch in batches:
            some = batch.filter(pa.array(picked.holds(batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x.tobytes() for x in _sets(some.column(1), s.words)], type=pa.binary())], names=["id", "s"])

    sets = scratch.written(docs.select("id", "t", F.xxhash64("id").alias("g")).mapInArrow(build, schema), f"{name}-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")

    def compare(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.int64) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * same >= s.percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, type=pa.bool_()))

    kind = docs.schema["id"].dataType
    return both.select("a", "b", "sa", "sb").mapInArrow(compare, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


@in_small_batches
def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row for each document: id, n_shingles, class_id (the smallest id with an equal set) and component_id (the smallest id that links reach)."""
    s, scratch = settings, Scratch(docs.sparkSession, "ngrams")
    written = scratch.written
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    heads = written(_frequent(docs.select("t"), s), "frequent-heads")
    every = written(heads.unionByName(_frequent(docs.select("t"), s, store_hashes(heads, scratch, "heads-sorted"))).distinct(), "frequent")
    described = written(_documents(docs, s, store_hashes(every, scratch, "frequent-sorted")), "documents")
    full = described.filter("n > 0 AND id IS NOT NULL")
    classes = written(full.groupBy("n", "f1", "f2").agg(F.min("id").alias("cls")), "classes")
    reps = full.select(F.col("id").alias("cls"), "n", "f1", "f2", "common", "prefix", "p1", "p2").join(classes, ["cls", "n", "f1", "f2"], "left_semi").dropDuplicates(["cls", "n", "f1", "f2"])
    reps = written(reps, "reps")
    first = written(reps.groupBy("n", "p1", "p2").agg(F.min(F.struct(-F.col("common"), F.col("cls"))).alias("m")).select("n", "p1", "p2", F.col("m.cls").alias("gid")), "first")
    grouped = written(reps.select("cls", "n", "p1", "p2").join(first, ["n", "p1", "p2"]), "grouped")
    groups = reps.withColumnRenamed("cls", "gid").join(first, ["gid", "n", "p1", "p2"], "left_semi").dropDuplicates(["gid", "n", "p1", "p2"])
    groups = written(groups.select("gid", "n", "common", "prefix"), "groups")
    members = grouped.select("gid", "cls", "n").distinct()
    tokens = groups.select("gid", "n", "common", F.posexplode("prefix").alias("at", "g"))
    # between groups n-grams of one group are of no use, nor is one that lies too far back for the smallest partner that it could meet
    shared = written(tokens.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1").select("g", "least"), "shared")
    smallest = F.greatest(F.col("least"), F.ceil(F.col("n") * s.percent / 100.0))
    tokens = written(tokens.join(shared, "g").filter(F.col("at") <= F.col("n") - _least_overlap(F.col("n"), smallest, s.percent)).drop("least"), "tokens")
    # the star around the group of most frequent n-grams, which in a family of copies is the one most like the others
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / s.percent)) + 1e-9)).cast("int")
    banded = tokens.withColumn("band", band)
    heads = banded.groupBy("g", "band").agg(F.min(F.struct(-F.col("common"), F.col("gid"), F.col("n"), F.col("at"))).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    heads = written(heads.select("g", "band", F.col("m.gid").alias("a"), F.col("m.n").alias("an"), F.col("m.at").alias("aat")), "heads")
    star = banded.join(heads, ["g", "band"]).filter(F.col("gid") != F.col("a")).filter(_can_meet("an", "aat", "n", "at", s)).select("a", F.col("gid").alias("b")).distinct()
    links = _bounded(written(star, "star"), groups, s).unionByName(members.filter("cls != gid").select(F.col("gid").alias("a"), F.col("cls").alias("b")))
    links = written(_verified(links, docs, s, scratch, "star"), "links")
    scratch.clear("star-sets", "star-pairs", "heads")
    same = written(components(links, "a", "b", scratch), "same")
    # what is still apart
    split = members.join(same, F.col("cls") == F.col("node"), "left").select("gid", "cls", "n", F.coalesce("component", "cls").alias("c"))
    split = written(split, "split")
    # a group over several components is paired under its first n-gram, even if no other group has it
    torn = split.groupBy("gid", "n").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("gid", "n")
    within = groups.join(torn, ["gid", "n"]).select(F.element_at("prefix", 1).alias("g"), "gid", "n", F.lit(0).alias("at"))
    parts = tokens.drop("common").unionByName(within).join(split.select("gid", "n", "c").distinct(), ["gid", "n"])
    mixed = written(parts.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("g"), "mixed")
    parts = written(parts.join(mixed, "g", "left_semi"), "parts")
    # between components first, so that pairs within one are never formed
    apart = parts.groupBy("g", "c").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min(F.col("at") - F.col("n")).alias("slack"))
    one, two = (apart.select("g", *[F.col(x).alias(f"{x}{k}") for x in ("c", "lo", "hi", "slack")]) for k in (1, 2))
    reach = (F.col("hi1") * 100 >= F.col("lo2") * s.percent) & (F.col("hi2") * 100 >= F.col("lo1") * s.percent)
    least = _least_overlap(F.col("lo1"), F.col("lo2"), s.percent)
    reach &= (-F.col("slack1") >= least) & (-F.col("slack2") >= least)
    between = one.join(two, "g").filter((F.col("c1") < F.col("c2")) & reach).select("g", "c1", "c2")
    left, right = (parts.select("g", F.col("c").alias(f"c{k}"), F.col("gid").alias(x), F.col("n").alias(f"n{k}"), F.col("at").alias(f"at{k}")) for k, x in ((1, "a"), (2, "b")))
    pairs = between.join(left, ["g", "c1"]).join(right, ["g", "c2"]).filter(_can_meet("n1", "at1", "n2", "at2", s)).select("a", "c1", "b", "c2").distinct()
    pairs = _bounded(written(pairs, "between"), groups, s)
    expand = [split.select(F.col("gid").alias(x), F.col("c").alias(f"c{k}"), F.col("cls").alias(f"m{k}")) for k, x in ((1, "a"), (2, "b"))]
    more = pairs.join(expand[0], ["a", "c1"]).join(expand[1], ["b", "c2"]).select(F.col("m1").alias("a"), F.col("m2").alias("b"))
    links = written(links.unionByName(_verified(more, docs, s, scratch, "more")), "all-links")
    same = written(components(links, "a", "b", scratch), "result")
    named = classes.join(same, F.col("cls") == F.col("node"), "left").select("n", "f1", "f2", "cls", F.coalesce("component", "cls").alias("component"))
    named = written(named, "named")
    rows = described.select("id", "n", "f1", "f2")
    apart = (F.col("n") == 0) | F.col("id").isNull()
    alone = rows.filter(apart).select("id", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    out = rows.filter(~apart).join(named, ["n", "f1", "f2"]).select("id", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), F.col("component").alias("component_id")).unionByName(alone)
    out = _kept(out, "ngram-components")
    scratch.clear()
    return out


def _with_sums(docs: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """All columns, then size and fingerprint of each document's set: __n, __f1, __f2."""
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL("__n long, __f1 long, __f2 long").fields])

    def add(batches):
        for batch in batches:
            rows = [(len(own), *_mixed_sums(own)) for own in _sets(batch.column(place), s.words)]
            sums = [pa.array(x, type=pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], names=[f.name for f in schema])

    return docs.mapInArrow(add, schema)


def _without(docs: DataFrame, id_col: str, gone: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs with an id of kept, all others having one of gone. Their hashes tell them apart where they are read, so that no text is shuffled; a hash that mixes any two up is not taken."""
    salt = 0
    while not kept.join(gone.select(F.xxhash64("id", F.lit(salt)).alias("__gone")), F.xxhash64("id", F.lit(salt)) == F.col("__gone")).isEmpty():
        salt += 1
    hashes = scratch.written(gone.select(F.xxhash64("id", F.lit(salt)).alias("g")).distinct(), "hashes")
    stored = store_hashes(hashes, scratch, "hashes-sorted")

    def stay(batches):
        for batch in batches:
            here = stored.holds(batch.column(batch.num_columns - 1).to_numpy())
            some = batch.filter(pa.array(~here))
            yield pa.RecordBatch.from_arrays(some.columns[:-1], names=batch.schema.names[:-1])

    return docs.select(*docs.columns, F.xxhash64(id_col, F.lit(salt)).alias("__hash")).mapInArrow(stay, docs.schema)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns; of equal ids and texts one row. Of rows without an id one of each set stays, and none whose set a document with an id has. Documents without words stay."""
    scratch = Scratch(docs.sparkSession, "ngram-gone")
    found = join(docs, id_col, text_col, settings).filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.when(F.col("n_shingles") > 0, F.col("component_id"))).alias("component"))
    found = scratch.written(found, "components")
    named, nameless = docs.filter(F.col(id_col).isNotNull()), docs.filter(F.col(id_col).isNull())
    left = _without(named, id_col, found.filter("id != component").select("id"), found.filter("component IS NULL OR id = component").select("id"), scratch)
    # only rows of ids that stand there more than once are dealt by text
    often = scratch.written(named.groupBy(id_col).count().filter("count > 1").select(F.col(id_col).alias("__often")), "often")
    again = F.col(id_col) == F.col("__often")
    out = left if often.isEmpty() else left.join(often, again, "left_anti").unionByName(left.join(often, again, "left_semi").dropDuplicates([id_col, text_col]))
    if nameless.isEmpty():
        return out
    sums = ["__n", "__f1", "__f2"]
    known = _with_sums(named.select(text_col), text_col, settings).select(*sums).distinct()
    nameless = _kept(_with_sums(nameless, text_col, settings), "ngram-nameless")
    some = nameless.filter("__n > 0").dropDuplicates(sums).join(known, sums, "left_anti")
    return out.unionByName(some.unionByName(nameless.filter("__n = 0")).select(*docs.columns))
