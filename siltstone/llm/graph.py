"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b): the component is its smallest node.

    Self-loops and repeated edges change nothing; edges with a null end are left out; no edges give no rows. Each round
    takes the least label around a node and then that label's own label, so long chains end in logarithmic time.
    """
    edges = edges.where("a is not null and b is not null")
    both = K.materialise(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept = K.materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("up_component"))
        jumped = least.join(up, least["component"] == up["up"], "left").select("node", F.least("component", "up_component").alias("component"), "before")
        kept = K.materialise(jumped, kept)
        if not kept.where("component <> before").limit(1).count():
            return kept.select("node", "component")
        labels = kept.select("node", "component")
