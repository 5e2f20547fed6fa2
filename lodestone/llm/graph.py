"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, discard


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) edges to (node, component), the component being its smallest node; only nodes with an edge appear.

    Alternating large-star and small-star steps: each is a minimum by node, which combines before the shuffle, and a
    join back.  Minima are written before the join, so that both its sides are plain exchanges, whose hot partitions (a
    hub's edges) adaptive execution splits.  It ends when every edge leads to a node without a smaller neighbour and
    every node has one such edge.  The rounds follow the logarithm of the largest component.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m")))
        large = cut(edges.join(least, "b").select("a", F.col("m").alias("b"), (F.col("b") != F.col("m")).alias("moved")))
        discard(edges, least)
        own = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"), F.max("moved").alias("moved")))
        if own.where("moved OR m < most").isEmpty():
            break
        small = large.join(own.select("a", "m"), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        discard(large, own)
    else:
        raise RuntimeError("components did not settle")
    return own.select(F.col("a").alias("node"), F.col("m").alias("component")).unionByName(own.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
