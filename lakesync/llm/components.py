"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesync.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b): every node's larger (or smaller) neighbours are hung on its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # partial aggregation: a hub sends one row per task
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = both.join(least, "a")
    if large:
        return hung.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("a <> m").select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (a, b, both long).

    Each round is written to the shared folder; only a count and a checksum
    come to the driver.  No edges: no rows.  Loops and repeats are allowed."""
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        now = stored(_stars(_stars(now, True), False), "edges")
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not converge")
    # now every edge is (node, least node)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))


__all__ = ["components"]
