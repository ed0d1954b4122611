"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of `edges` (columns a, b: longs): comp is the smallest node that links reach.

    Alternating large-star and small-star steps: each step points a node's neighbours at the smallest one, until every
    edge points at its component's smallest node. Steps are minima and joins, so a hub's edges are never gathered in
    one row; each round is stored, so lineage stays short. The result is stored too.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(low.select("a", F.col("m").alias("b")))
        after = saved(small.distinct())
        drop(now)
        now, before, state = after, state, _state(after)
        if state == before:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
            out.saved_path = now.saved_path  # for drop()
            return out


def _state(edges: DataFrame) -> tuple:
    """A count and a checksum: equal before and after a round when nothing changes any more."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())
