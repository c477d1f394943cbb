"""Connected components of a table of links, by alternating stars.

Each round hangs a node's larger neighbours on its smallest one (large star), then its smaller ones (small star), until
nothing changes. Rounds are grouped minima and joins over the links; every round is kept in the shared folder. The rounds
grow with the logarithm of the longest chain. A node with very many links is reduced by partial minima before the shuffle,
and its side of the join is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised


def _hung(links: DataFrame, both: bool) -> DataFrame:
    """Each node's neighbours (those on either side, or only the smaller ones) hung on the smallest of them."""
    near = links.select("a", "b")
    if both:
        near = near.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = near.join(least, "a")
    if both:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: every node that has a link to another node, and the smallest node reachable from it."""
    now = materialised(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct())
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, after = None, sign(now)
    while before != after:
        # small star wants a > b in every link; large star gives just that
        now = materialised(_hung(_hung(now, True), False))
        before, after = after, sign(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
