"""Connected components of an edge table, by alternating stars.

Each round links the larger neighbours of a node to the smallest one (large
star), then all smaller neighbours to the smallest one (small star). The
number of rounds grows with the logarithm of the longest path. Each round is
written to the shared folder; nothing but a row count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbraid.llm.shared import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b) bigint; component is the smallest id."""
    edges = edges.where("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = stored(edges.distinct())
    while True:
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.where("u != v").union(lowest.select("u", F.col("low").alias("v")))
        after = stored(small.distinct())
        # In a forest of stars no centre has a smaller neighbour and no leaf two.
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    centres = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.selectExpr("u AS id", "v AS component").union(centres)
