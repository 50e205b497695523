"""Connected components of a graph of long ids, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.session import forget, settled


def _lowest(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, m): every neighbour v of u with u's lowest neighbour; and the written minima.

    The minima are written first: a join of two plain shuffles is one whose hub Spark can split.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
    return pairs.join(low, "u"), low


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id of an edge, the smallest id it can reach.

    Large-star and small-star steps alternate until the edges are stars around the smallest ids. Each round is written
    to the checkpoint folder as a table, so that its lineage and its estimated size end there. Self-loops and repeated edges are harmless; without edges
    the result is empty.
    """
    now = settled(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    while not _are_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        high, first = _lowest(both)
        large = high.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # Now every u has only lower neighbours.
        low, second = _lowest(large)
        small = low.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v")))
        before, now = now, settled(small.where("u > v").distinct())
        forget(before, first, second)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", F.col("v").alias("w")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every higher end has one edge and is no lower end."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()
