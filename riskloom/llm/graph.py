"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for the end points of edges (a, b).

    Every round takes the smallest label among a node and its neighbours, then the label of that label, so the rounds grow
    with the logarithm of a chain's length. Labels are written to the shared folder each round. No edges give no rows.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "next").distinct(), "edges")
    held = labels = written(both.groupBy("node").agg(F.least("node", F.min("next")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "next"), "next").groupBy("node").agg(F.min("component").alias("near"))
        nearer = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        jumped = nearer.join(labels.select(F.col("node").alias("via"), F.col("component").alias("far")), "via").select("node", "old", F.least("via", "far").alias("component"))
        now = written(jumped, "labels")
        discard(held)
        held, labels = now, now.select("node", "component")
        if now.where("old <> component").isEmpty():
            discard(both)
            return labels
