"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(pairs: DataFrame, name: str) -> DataFrame:
    """pairs(u, v) → (u, v, m), m the smallest of u and its neighbours.

    The minima are combined map-side and written, so the join exchanges both
    sides and a centre with many neighbours can be split.
    """
    least = materialize(pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("least")), name)
    return pairs.join(least, F.col("u") == F.col("_u")).select("u", "v", F.least("u", "least").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) → (node, root): the smallest node of each node's component.

    Nodes without an edge to another node are left out.  Each round is written
    to the shared folder; the number of rounds grows with the logarithm of the
    longest path.
    """
    tree = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    state = None
    while True:
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "cc-large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "cc-large-out")
        small = _star(large, "cc-small")
        tree = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        tree = materialize(tree.where("u != v").distinct(), "cc-tree")
        # Two numbers that describe the forest; it is stable when they stay.
        now = tree.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            return tree.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                tree.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
