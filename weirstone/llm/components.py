"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirstone.llm._spark import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (columns a, b: long); component is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the label of that label,
    so chains shorten by more than half a round. Rounds go on until no label changes; nothing but
    that one count reaches the driver. An empty edge table gives no rows. Null ends are ignored.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    while True:
        labels = written(labels)
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        step = written(step.join(jump, "to", "left").select("node", "was", F.least("to", "beyond").alias("component")))
        labels = step.select("node", "component")
        if step.where("was <> component").isEmpty():
            return labels
