"""Connected components by alternating large and small stars, each round a pair of joins.

Every round links each node to the smallest node near it; the number of rounds grows with the logarithm of the graph.
A hub is no problem: minima are aggregated before the shuffle, and the join back is on two shuffled inputs, which
adaptive execution can split. Each round is written to the shared store, so lineage stays short and a lost executor
costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenq.llm.columns import Scratch


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = scratch.fresh(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
    return both.join(low, "u").filter("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    low = scratch.fresh(edges.groupBy("u").agg(F.min("v").alias("m")), "stars")
    moved = edges.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, scratch: Scratch | None = None) -> DataFrame:
    """node and component, the smallest node it is linked with; only nodes of edges between two different nodes. The tables of all rounds, also the last, which the result reads, lie in scratch; its owner clears it."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = scratch.fresh(now, "edges")
    state = _state(now)
    while state[0]:
        now = scratch.fresh(_small_star(scratch.fresh(_large_star(now, scratch), "edges"), scratch), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    own = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
