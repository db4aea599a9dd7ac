"""Connected components of a distributed edge list, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of ``edges``; direction doesn't matter.

    Each round gives a node the least label of its neighbours and then its label's label, so that labels travel twice as
    far as before; rounds are about the logarithm of the longest shortest path. Only the number of changes reaches the
    driver. Each round is written to the shared folder. Minima are combined before the shuffle, so that a node with very
    many edges doesn't gather them in one task.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = materialize(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "component-edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "component-labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("heard"))
        low = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "heard").alias("low"))
        low = materialize(low, "component-low")
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("further"))
        labels = materialize(low.join(jump, "low").select("node", "old", F.least("low", "further").alias("component")), "component-labels")
        if labels.where("component <> old").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
