"""Connected components of an undirected graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._spark import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours to the least node of each neighbourhood: the larger ones, or the smaller ones and the node itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """For edges (u, v) of bigint nodes, (u, v) of each node but the least of its component, v being that least node.

    Null ends and loops are left out; repeated edges count once; without edges the result is empty. Each round is cut off by a
    reliable checkpoint, and the rounds stop when the edges no longer change: every component is then a star.
    """
    now = edges.filter("u is not null and v is not null and u != v")
    now = checkpointed(now.select(F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v")).distinct())
    sign = None
    while True:
        now = checkpointed(_star(_star(now, True), False))
        # a star has its centre as the only smaller neighbour of every node, and no node is both a centre and a member
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == sign:
            return now
        sign = (row.n, row.s)
