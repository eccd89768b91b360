"""Connected components of a table of links, without gathering any neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_groups(links: DataFrame) -> DataFrame:
    """(node, root): every node of a link (a, b) with the smallest node it can reach.

    Each round replaces every link by one that leads to a smaller node, so links never grow in number and turn into stars
    whose centres are the roots. Minima are combined before the shuffle; a node with very many links only ever shows up as
    many rows. A round is a stored table; the rounds end when the links no longer change.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before = tuple(now)
        # Of its smaller neighbours a node keeps the least, or what that one keeps; the others move to the least.
        least = edges.groupBy("a").agg(F.min("b").alias("low"))
        kept = least.join(least.select(F.col("a").alias("low"), F.col("low").alias("lower")), "low", "left").select(
            "a", F.coalesce("lower", "low").alias("b"))
        moved = edges.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = cut_lineage(kept.union(moved).select("a", "b").distinct())
