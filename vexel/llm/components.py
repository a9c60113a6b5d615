"""Connected components by repeated contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import settled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge between two different nodes; label is the smallest node of its component.

    Each round points every node at its smallest neighbour, or itself if that is smaller, and contracts the edges;
    what remains shrinks fast, and each round is written to the shared folder so no lineage grows. Edges with a null
    end or from a node to itself are ignored, repeated edges count once; no edges give no rows.
    """
    rest = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a is not null and b is not null and a < b").distinct()
    rest = settled(rest)
    labels = None
    while True:
        both = rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).select(F.col("a").alias("n"), "p")
        parent = settled(parent)
        if labels is None:
            labels = parent.select(F.col("n").alias("node"), F.col("p").alias("label"))
        else:
            labels = labels.join(parent, labels["label"] == parent["n"], "left").select("node", F.coalesce("p", "label").alias("label"))
            labels = settled(labels)
        pa, pb = parent.select(F.col("n").alias("a"), F.col("p").alias("pa")), parent.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        rest = rest.join(pa, "a").join(pb, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        rest = settled(rest)
        if rest.isEmpty():
            return labels
