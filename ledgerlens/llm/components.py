"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; the root is the smallest node reached.

    Each round writes its labels to the shared folder. A round takes the smallest label among the
    neighbours (combined before the shuffle, so a hub is no hot group) and then the label of that
    label, so the number of rounds is about the logarithm of the longest path.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b")
    both = written(both, f"{purpose}-edges")
    labels = written(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")),
        purpose,
    )
    while True:
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "root")
        nearest = near.union(labels).groupBy("node").agg(F.min("root").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = written(
            nearest.join(up, "root", "left").select(
                "node", F.least("root", F.coalesce("top", "root")).alias("root")
            ),
            purpose,
        )
        old = labels.withColumnRenamed("root", "old")
        moved = after.join(old, "node").filter("root <> old").limit(1).count()
        labels = after
        if not moved:
            return labels
