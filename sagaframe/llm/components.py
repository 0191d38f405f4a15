"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, materialize


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Add ``m``, the least of ``a`` and its neighbours, to ``edges(a, b)``; a hub's links stay where they are."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_spread(edges, materialize(least, "least"), "a", ["m"], total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    marked = _with_least(edges, total)
    moved = marked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(marked.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node reachable.

    Roots are rows of the result too. Self-links and repeated links change nothing; null ends
    are ignored; no edges give no rows. Every round is written to the shared folder, and the
    loop ends when a round changes no edge.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = state(links)
    while now[0]:
        large = materialize(_large_star(links, now[0]), "large")
        links = materialize(_small_star(large, now[0]), "edges")
        before, now = now, state(links)
        if before == now:
            break
    members = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
