"""Connected components of an edge table, by alternating large and small stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.shared import kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the neighbours of each node onto the smallest of them and the node itself.

    Large: those above the node, seen from all its neighbours. Small: those below it, and the node.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))  # combined before the shuffle, whatever the degree
    seen = both.join(least.select("u", F.least("u", "m").alias("m")), "u")
    hung = seen.where("v > u" if large else "v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        hung = hung.unionByName(least.select(F.col("u").alias("a"), F.least("u", "m").alias("b")))
    return hung.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b of one type that has an order) to rows (a, b) in which b is the smallest node of the component of a, without a = b."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges, before = kept(edges), None
    while True:
        edges = kept(_star(_star(edges, large=True), large=False))
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == before:
            return edges
        before = now
