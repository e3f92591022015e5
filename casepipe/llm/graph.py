"""Connected components of a link table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepipe.llm.common import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``links(a, b)``; the component is
    its least node.

    Each round takes the least label among a node's own and its neighbours',
    then the label of that label; minima are aggregated before they are
    shuffled, so a node with very many links is no hot spot.  Rounds grow with
    the logarithm of the longest shortest path for chains of ordered labels.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label")
        least = labels.unionByName(near).groupBy("node").agg(F.min("label").alias("least"), F.max("label").alias("most"))
        up = labels.select(F.col("node").alias("least"), F.col("label").alias("jump"))
        after = least.join(up, "least").select("node", F.col("jump").alias("label"), (F.col("least") != F.col("most")).alias("moved"))
        after = stored(after, "labels")
        drop_stored(labels)
        labels = after.drop("moved")
        labels.stored_at = after.stored_at
        if not after.where("moved").limit(1).count():
            drop_stored(both)
            return labels.withColumnRenamed("label", "component")
