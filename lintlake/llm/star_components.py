"""Connected components by alternating large-star and small-star operations on an edge table.

Edges point from the larger node to the smaller.  A large-star links the larger neighbours of each
node to its smallest neighbour (itself included), a small-star the smaller ones and the node itself.
Neither adds edges, and where both change nothing every component is a star around its smallest
node.  A node with very many edges is never gathered: its smallest neighbour is an aggregate that
combines in the map tasks, joined back between written tables, where Spark splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
    # v > u: an edge of the table read backwards
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return written(larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    least = written(edges.groupBy("u").agg(F.min("v").alias("m"), (F.min("v") != F.max("v")).alias("several")), "star-least")
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star"), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.  Loops and repeated edges do no harm."""
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-edges")
    while True:
        now, least = _small_star(_large_star(now))
        # stars: each node has one smaller neighbour, which has none itself
        if least.where("several").isEmpty() and now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
