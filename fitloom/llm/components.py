"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest reachable node.

    edges: long columns a and b, in any order and with repeats; loops are
    ignored.  Each step only takes minima with map-side combine and joins on
    a node, so a node of very high degree is never gathered in one task
    (AQE splits the join).  No edge gives no row.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    before = None
    while True:
        # Large star: every larger neighbour of u links to u's smallest neighbour or u.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # Small star: u and its smaller neighbours link to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.keep(small, "edges")
        state = _state(new)
        scratch.drop(now)
        now = new
        if state == before or state[0] == 0:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
