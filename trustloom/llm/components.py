"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.session import materialise


def components(links: DataFrame) -> DataFrame:
    """Rows (node, label) for every node of ``links`` (a, b): the smallest node of its component.

    Every round takes the smallest label among a node's neighbours and then the label of that label, so a component's
    depth shrinks by more than half a round. Labels go to a written table after each round, which cuts the lineage.
    Labels only ever fall, so their sum tells whether a round changed any.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.where(F.col("a") != F.col("b")).distinct(), "links")
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = materialise(met.join(of, "label").select("node", F.least("label", "root").alias("label")), "labels")
