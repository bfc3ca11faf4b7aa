"""Connected components of a graph in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandjoin.llm.common import stage


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's smallest node.

    Every round takes the smallest label among a node and its neighbours and then the label of
    that label, so that paths halve. Each round is a written table; nothing reaches the driver
    but the number of changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    for turn in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("root").alias("near"))
        met = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        following = met.join(up, "root").select("node", "old", F.least("root", "up").alias("root"))
        following = stage(following, f"labels-{turn}")
        changed = following.where(F.col("old") != F.col("root")).limit(1).count()
        labels = following.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
