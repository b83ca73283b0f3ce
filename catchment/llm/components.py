"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b); root is the smallest node.

    Stars are made by turns around each node's smallest neighbour, among its larger and then
    among its smaller neighbours, until nothing changes: a number of rounds that grows with
    the logarithm of the longest path. Every round is written to the shared folder.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = materialize(edges.filter("a <> b").select(high.alias("a"), low.alias("b")).distinct(),
                        "links")
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(smallest, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = materialize(large, "links")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
        links = materialize(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
