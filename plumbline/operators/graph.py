"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.sources.storage import materialise, release


def _lowest(sym: DataFrame) -> DataFrame:
    """Each node ``u`` with the smallest of itself and its neighbours ``v``."""
    return sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Label each node that has an edge with the smallest node id that it can reach.

    Alternates large-star and small-star rounds (each node hands its larger, then its smaller
    neighbours to the smallest one that it sees) until the edge set stands still. A hub with very many
    neighbours never lands in one task: its minimum combines before the shuffle, and the minima are written before
    they are joined, so that both sides of the join are plain shuffles, of which AQE splits the long partitions. The
    rounds grow with the logarithm of the longest path. Self-loops, repeated edges and nulls are allowed and change
    nothing; no edge gives an empty result.

    Returns ``node, component``.
    """
    e = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b")
    e = materialise(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(_lowest(sym), "lowest")
        large = materialise(sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        release(low)
        release(e)
        low = materialise(_lowest(large), "lowest")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        release(low)
        release(large)
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == seen:
            break
        seen = state
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
