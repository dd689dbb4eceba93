"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.tables import durable


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to node and component, its smallest node. Labels fall to the neighbours' smallest, then to the
    label's own label, until none changes; each round is written, so lineage stays short."""
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = durable(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        roots = step.select(F.col("node").alias("root"), F.col("next").alias("further"))
        jumped = durable(step.join(roots, step.next == roots.root, "left").select("node", "old", F.least("next", F.coalesce("further", "next")).alias("component")), "labels")
        labels = jumped.select("node", "component")
        if jumped.where("old <> component").isEmpty():
            return labels
