"""Connected components of link tables that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars: no node with two targets, and no target that has one itself."""
    return links.groupBy("a").count().where("count > 1").isEmpty() and links.join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, comp): the least node each node of ``edges`` (a, b) reaches.

    Alternates large-star and small-star steps, each of which is one aggregation by node; lineage is cut into the
    shared folder after every round, so a lost executor costs one round. Rounds grow with the logarithm of the
    longest chain.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if _settled(links):
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.where("m < a").select("a", F.col("m").alias("b"))
        )
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        links = cut(small.where("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))
