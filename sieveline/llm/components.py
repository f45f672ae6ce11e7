"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the node's smallest neighbour."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them. Needs ``b < a``."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links (a, b)``; ``root`` is the smallest node reachable.

    The links never leave the cluster: each round is two grouped minima and
    two joins, its result is written to the shared folder, and the rounds end
    when the links no longer change (their number and a checksum). A node's
    minimum is aggregated before it is shuffled, and a hot node's rows can be
    split by adaptive skew joins. Self-links and repeated links are harmless.
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        seen = links.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(a, b) as decimal(20, 0))"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        links = materialize(_small_star(_large_star(links).where("a <> b")), "links")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select("b", "b").distinct())
