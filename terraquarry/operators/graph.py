"""Connected components of a graph that is too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraquarry.storage import release, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), of any type that has an order: a component is named by its least node.

    Each round lets every node look at its least neighbour and at that one's, and contracts
    the graph to what they point to; the rounds grow with the logarithm of a component's
    size. A node of many edges is no group: least neighbours are partial aggregates. Each
    round's tables are written to the shared folder.
    """
    left = stored(edges.where("a <> b").select("a", "b").distinct(), "graph-edges")
    named: DataFrame | None = None
    while named is None or not left.isEmpty():
        ways = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("near"))
        beyond = least.select(F.col("node").alias("near"), F.col("near").alias("far"))
        points = stored(least.join(beyond, "near").select("node", F.col("far").alias("component")), "graph-points")
        follow = points.select(F.col("node").alias("component"), F.col("component").alias("next"))
        renamed = points if named is None else stored(named.join(follow, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "graph-names")
        ends = [points.select(F.col("node").alias(e), F.col("component").alias(f"{e}_to")) for e in "ab"]
        fewer = left.join(ends[0], "a").join(ends[1], "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        fewer = stored(fewer, "graph-edges")
        release(left, named, *([] if named is None else [points]))
        left, named = fewer, renamed
    release(left)
    return named
