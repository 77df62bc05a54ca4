"""Distributed union-find over an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): every node of an edge with the least node
    that it reaches.

    Rounds of large-star and small-star: a node's neighbours are linked to the
    least of them, first the larger neighbours, then the smaller ones, until
    the edges are stars. The state is one row per edge, kept as a table in the
    shared folder until the next one is written; the driver sees a count and a
    checksum a round. Least
    neighbours come from aggregations that combine before the shuffle, and
    nodes with many edges are split by the adaptive skew join.
    """
    two = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = state.select(F.inline(two))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        before, state = state, stored(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        seen = now
