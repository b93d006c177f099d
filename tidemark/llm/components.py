"""Connected components of a table of links, by the alternation of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (itself included)."""
    each = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = each.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return each.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (a, b), for every linked node.

    Each round is written to the shared checkpoint folder; rounds grow with the logarithm
    of the longest path. A node with very many links never meets in one task: its links
    are folded by minimum before the shuffle, and joined to that one row, which Spark
    can split. Links to itself are left out; no links give no rows.
    """
    now = materialize(links.select("a", "b").where("a <> b").distinct())
    while True:
        stars = materialize(small_star(large_star(now)))
        # done when every node has one link, and no root is linked itself
        state = stars.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        before = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before:
            break
        now = stars
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
