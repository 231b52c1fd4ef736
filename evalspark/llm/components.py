"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evalspark.llm.frames import materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the smallest node among u and its neighbours; the minimum is combined before it is shuffled."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) for links a - b.

    Every round rewires each node's larger, then its smaller neighbours to the
    smallest node known; the rounds grow with the logarithm of the longest
    chain.  Each round's links are written to the shared folder.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        seen = now
        both = edges.union(edges.select("v", "u"))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u > v").distinct(), "large-star")
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
        edges = materialize(small.filter("u > v").distinct(), "small-star")
