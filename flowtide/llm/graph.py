"""Connected components by alternating stars, for edge lists of any size and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), two long columns; root is the least node it can reach.

    Each round hangs the neighbours of a node on its least neighbour, first those above it, then those
    below it, until every tree is a star. Least neighbours are partial aggregates, kept as a table, and
    are joined to the edges by a plain join, so that a node with very many edges can be split.
    Loops and repeated edges are harmless; edges with a null end are left out.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    now = stored(
        both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(size) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = tuple(size)
        now = _small(_large(now))


def _large(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node goes to the node's least neighbour (or the node itself)."""
    least = stored(
        edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
        .union(edges.select(F.col("b").alias("n"), F.col("b").alias("m")))
        .groupBy("n").agg(F.min("m").alias("m")), "least",
    )
    # a is above b in every edge, so the neighbours above n are the a of edges whose b is n.
    return stored(edges.join(least, edges.b == least.n).select("a", F.col("m").alias("b")).distinct(), "edges")


def _small(edges: DataFrame) -> DataFrame:
    """Each neighbour below a node, and the node itself, go to the least of them."""
    least = stored(edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
    below = edges.join(least, edges.a == least.n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return stored(below.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
