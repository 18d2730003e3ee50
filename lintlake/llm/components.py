"""Connected components of an edge table, by rounds of joins; nothing of it passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Each round takes the smallest label of the neighbours, then the label of the label, so the
    rounds grow with the logarithm of a component's length.  Both inputs of each join are
    written tables, so Spark can split a node with very many edges.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "labels")
    while True:
        heard = both.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("root").alias("heard"))
        near = written(labels.join(heard, F.col("node") == F.col("b"), "left").select("node", "root", F.least("root", F.coalesce("heard", "root")).alias("next")), "labels")
        there = near.select(F.col("node").alias("next"), F.col("next").alias("root_there"))
        after = written(near.join(there, "next").select("node", F.least("next", "root_there").alias("root"), (F.col("root") != F.least("next", "root_there")).alias("moved")), "labels")
        labels = after.select("node", "root")
        if after.where("moved").isEmpty():
            return labels
