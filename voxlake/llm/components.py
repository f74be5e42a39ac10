"""Connected components of an edge list by alternating large-star and small-star steps, in DataFrames.

The number of rounds is logarithmic in the size of a component, a step makes no more edges than it gets, minima are combined
before the shuffle, and every round is written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxlake.llm.common import stored


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def unfinished(edges: DataFrame) -> DataFrame:
    """Nodes with several edges up, or with edges both up and down: none are left when every component is a star."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node that is not itself the smallest of its component. `edges` has long columns a and b."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not unfinished(edges).isEmpty():
        edges = stored(small_star(large_star(edges)), "edges")
    return edges.select("a", F.col("b").alias("root"))
