"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: the sources share a total by weight; none gets more than cap times its size, and the excess goes to the
others by weight (water filling). Documents: within a source each document expects so many copies that they add up to
the target, fewer for short documents. The whole part of that number is certain. The rest is an inclusion probability
p, and documents are ranked by (u / (1 - u)) / (p / (1 - p)) with u uniform by a hash of the id; the source takes the
head of that order, as much as its target leaves after the certain copies. The sample's size is fixed in words, which
is what targets are in: the head ends with the document at whose middle the target lies, and a second pass fills the
rest of the gap with later documents that fit into it.

The order is never sorted as a whole. Ranks fall into 65,536 equal intervals of r / (1 + r), whose sums tell for all
intervals but one of each source whether they are in; only that interval is ordered row by row. So a document's copies
follow from its own row and a small table, and texts of the mix are not shuffled, but for those of these intervals.

Defined results: a null text has size 0; null is a source of its own, the last; a null id counts as an empty one;
documents of size 0 take 0 words; repeated rows are documents of their own, with equal ranks; an empty table gives an
empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenq.llm.columns import written

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 65536
PARTS = 1024
#: Rows of a table of sources up to which it is broadcast.
SMALL = 10_000
#: Documents of fewer than 2**FULL - 1 words expect fewer copies, by half for each power of two.
FULL = 6
#: Expected copies that are so near to a whole number are that number.
NEAR = 1e-9


def uniform(id_col: Column) -> Column:
    """In (0, 1), from the first 52 bits of the id's MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def length_class(size: Column) -> Column:
    """0 for no words, k for 2**k - 1 words and more, FULL at most."""
    return sum(((size >= 2**k - 1).cast("int") for k in range(1, FULL + 1)), F.lit(0))


def fill(frame: DataFrame, within: list[str], total: str, cap: str, weight: str, order: list[str]) -> DataFrame:
    """Adds share: the total of each group, by weight, none above its cap, the excess reshared. One row for each sharer."""
    group = Window.partitionBy(*within)
    rising = group.orderBy("__ratio", *[F.col(c).asc_nulls_last() for c in order])
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    out = frame.withColumn("__ratio", F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(0.0))
    out = out.withColumn("__level", F.when(F.sum(weight).over(after) > 0, (F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum(weight).over(after)).otherwise(0.0))
    out = out.withColumn("__full", F.col("__ratio") <= F.col("__level"))
    out = out.withColumn("__line", F.min(F.when(~F.col("__full"), F.struct("__ratio", *order, "__level"))).over(group)["__level"])
    return out.withColumn("share", F.when(F.col("__full"), F.col(cap).cast("double")).otherwise(F.least(F.col(cap).cast("double"), F.col(weight) * F.col("__line")))).drop("__ratio", "__level", "__full", "__line")


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, cap: int = 2) -> DataFrame:
    """source, source_size, target. There is a row for each source here, so the window over all of them is small."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("place", place).withColumn("weight", cycle.cast("long")).withColumn("most", F.col("source_size") * cap)
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * percent / F.lit(100.0))
    return fill(per, [], "total", "most", "weight", ["place"]).select("source", "source_size", F.col("share").alias("target"))


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _small(frame: DataFrame, name: str) -> DataFrame:
    frame = written(frame, name)
    return F.broadcast(frame) if frame.count() <= SMALL else frame


def _ranked(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds certain, rank, bucket and open to rows of id, source, size and class."""
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).drop("s", "c")
    rows = rows.withColumn("certain", F.floor(F.col("expected") + NEAR).cast("long")).withColumn("p", F.col("expected") - F.col("certain")).withColumn("u", uniform(F.col("id")))
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank", F.when(F.col("p") > NEAR, rank / (1 + rank)))
    rows = rows.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.col("rank") * BUCKETS)).cast("int"))
    return rows.withColumn("open", F.col("rank").isNotNull())


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, cap: int = 2) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, copies and taken (words)."""
    chosen, *_ = _mix(docs, id_col, text_col, source_col, weights, percent, cap)
    return chosen.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, cap: int = 2) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Rows with their copies, apart: whether these depend on other rows of their interval; what copies expect; the lines of both passes."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size"))
    sized = written(sized.withColumn("class", length_class(F.col("size"))), "mix-sizes")
    per = targets(sized, weights, percent, cap)
    # expected copies: the same for all documents of a source and a length class
    classes = sized.groupBy("source", "class").agg(F.sum("size").alias("class_size"))
    classes = classes.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    classes = classes.withColumn("most", F.col("class_size") * cap).withColumn("weight", F.col("class_size") * F.pow(F.lit(2.0), F.col("class") - FULL))
    classes = fill(classes, ["source"], "target", "most", "weight", ["class"])
    expected = F.when(F.col("class_size") > 0, F.least(F.lit(float(cap)), F.col("share") / F.col("class_size"))).otherwise(0.0)
    plan = _small(classes.select(F.col("source").alias("s"), F.col("class").alias("c"), "source_size", "target", expected.alias("expected")), "mix-plan")
    rows = _ranked(sized, plan)
    first = _lines(rows, False, "mix-first-lines")
    chosen = _head(rows.withColumn("apart", F.lit(False)), first, False)
    chosen = chosen.withColumn("certain", F.col("certain") + F.col("more")).withColumn("open", F.col("open") & (F.col("more") == 0)).drop("more")
    chosen = written(chosen, "mix-first")
    second = _lines(chosen, True, "mix-second-lines")
    chosen = _head(chosen, second, True).withColumn("copies", F.col("certain") + F.col("more"))
    return chosen, plan, [first, second]


def _able(only_fitting: bool) -> Column:
    able = F.col("open") & (F.col("left") > 0)
    return able & (F.col("size") <= F.col("left")) if only_fitting else able


def _lines(rows: DataFrame, only_fitting: bool, name: str) -> DataFrame:
    """For each source s: left (words of the target that are not yet taken), upto (the last interval of open rows that is in as a whole), edge (the one in which the target lies) and start (words ahead of it)."""
    left = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("certain") * F.col("size"))).alias("left"))
    left = _small(left.select(F.col("source").alias("s"), "left"), f"{name}-left")
    able = rows.join(left, F.col("source").eqNullSafe(F.col("s"))).filter(_able(only_fitting))
    sums = able.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("left").alias("left"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    sums = sums.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("words"))
    edge = F.when((F.col("start") < F.col("left")) & (F.col("upto") > F.col("left")), F.struct("bucket", "start"))
    ends = sums.groupBy("source").agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("bucket"))).alias("upto"), F.min(edge).alias("edge"))
    lines = left.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    return _small(lines.select("s", "left", "upto", F.col("edge.bucket").alias("edge"), F.col("edge.start").alias("start")), name)


def _beside(rows: DataFrame, lines: DataFrame, only_fitting: bool) -> DataFrame:
    """Adds left, start, inside (in the head as a whole interval) and at_edge (in the interval that is ordered row by row)."""
    rows = rows.join(lines, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rows = rows.withColumn("inside", F.coalesce(_able(only_fitting) & (F.col("bucket") <= F.col("upto")), F.lit(False)))
    return rows.withColumn("at_edge", F.coalesce(_able(only_fitting) & (F.col("bucket") == F.col("edge")), F.lit(False))).drop("upto", "edge")


def _head(rows: DataFrame, lines: DataFrame, only_fitting: bool) -> DataFrame:
    """Adds more: 1 for open rows in the head of their source's order, as far as the target is not yet taken. Rows at an edge are apart."""
    rows = _beside(rows, lines, only_fitting)
    edge = F.col("at_edge")
    # outside the one interval in which the target lies, rows are dealt out by a hash, as their order does not matter
    spread = F.when(edge, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id", "size"), F.lit(4096)))
    order = Window.partitionBy("source", spread).orderBy("rank", F.col("id").asc_nulls_last(), "size")
    done = F.col("start") + F.sum(F.when(edge, F.col("size")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    head = F.col("inside") | (edge & (2 * done + F.col("size") <= 2 * F.col("left")))
    rows = rows.withColumn("more", F.coalesce(head, F.lit(False)).cast("long")).withColumn("apart", F.col("apart") | edge)
    return rows.drop("left", "start", "inside", "at_edge")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: every document as many times as it has copies, with all its columns. Rows that agree in id, source and size share their copies as evenly as whole numbers allow."""
    found, plan, (first, second) = _mix(docs, id_col, text_col, source_col, **settings)
    # copies of all rows but those at an edge follow from the row itself
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size"))
    rows = _ranked(rows.withColumn("class", length_class(F.col("size"))), plan)
    rows = _beside(rows, first, False).withColumnRenamed("at_edge", "apart").withColumn("open", F.col("open") & ~F.col("inside"))
    rows = rows.withColumn("certain", F.col("certain") + F.col("inside").cast("long")).drop("left", "start", "inside")
    rows = _beside(rows, second, True).withColumn("apart", F.col("apart") | F.col("at_edge")).withColumn("copies", F.col("certain") + F.col("inside").cast("long"))
    alone = rows.filter(~F.col("apart") & (F.col("copies") > 0)).select("row.*", F.col("copies").alias("__copies"))
    key = ["id", "source", "size"]
    edge = written(rows.filter("apart").select("row.*", *[F.col(k).alias(f"__{k}") for k in key]), "mix-edge")
    found = found.filter("apart").groupBy(*key).agg(F.sum("copies").cast("long").alias("__total"), F.count(F.lit(1)).alias("__rows"))
    found = written(found.filter("__total > 0").select(*[F.col(k).alias(f"__{k}2") for k in key], "__total", "__rows"), "mix-copies")
    group = [f"__{k}" for k in key]
    same = F.lit(True)
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"{c}2"))
    again = edge.join(found, same).drop(*[f"{c}2" for c in group])
    # rows that agree in id, source and size are numbered, in parts by text so that many of them are not one task
    again = again.withColumn("__part", F.when(F.col("__rows") > 1, F.pmod(F.xxhash64(text_col, *[c for c, t in docs.dtypes if c != text_col and not t.startswith("map")]), F.lit(PARTS))).otherwise(0))
    parts = again.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    parts = written(parts.select(*[F.col(c).alias(f"{c}2") for c in group], F.col("__part").alias("__part2"), "__before"), "mix-parts")
    again = again.join(parts, same & (F.col("__part") == F.col("__part2")))
    number = F.col("__before") + F.row_number().over(Window.partitionBy(*group, "__part").orderBy(F.xxhash64(text_col)))
    each = F.floor(F.col("__total") / F.col("__rows")) + (number <= F.col("__total") % F.col("__rows")).cast("long")
    again = again.withColumn("__copies", each).filter("__copies > 0")
    kept = [*docs.columns, "__copies"]
    out = alone.select(*kept).unionByName(again.select(*kept))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)
