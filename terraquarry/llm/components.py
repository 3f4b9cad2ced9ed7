"""Connected components of a graph of edges, by contraction, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquarry.llm import common


def connected_components(edges: DataFrame) -> DataFrame:
    """The smallest node of each node's component, for nodes with an edge: node, component; written to shared storage.

    ``edges`` has two long columns, a and b; loops, repeats and either direction are fine,
    and an edge with a null end is none. Each round lets every node point to its smallest
    neighbour, follows one more pointer, and contracts the graph along the pointers; the
    rounds grow with the logarithm of a component's size. Every round's tables are written
    to shared storage, and deleted when the next round's are there.
    """
    links = common.materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while labels is None or not links.isEmpty():
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        ahead = near.select(F.col("a").alias("p"), F.col("p").alias("q"))
        step = common.materialize(near.join(ahead, "p").select(F.col("a").alias("node"), F.col("q").alias("component")), "step")
        if labels is None:
            new = step
        else:
            moved = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
            new = common.materialize(labels.join(moved, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
        at = step.select(F.col("node").alias("a"), F.col("component").alias("x"))
        to = step.select(F.col("node").alias("b"), F.col("component").alias("y"))
        fewer = links.join(at, "a").join(to, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        fewer = common.materialize(fewer, "edges")
        common.drop(links, labels, step if labels is not None else None)
        links, labels = fewer, new
    common.drop(links)
    return labels
