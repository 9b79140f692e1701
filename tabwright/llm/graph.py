"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); one root per component.

    Each round sends every node to the smallest node of its neighbourhood and keeps the edges
    between different images. Nodes must be in an order unrelated to the graph (hashes), so that
    about half of a path's nodes are left after a round. Hubs are reduced by a minimum before the
    shuffle; no neighbour list is built. Loops and repeated edges are allowed.
    """
    levels = []
    edges = stage_table(edges.where("a <> b").select("a", "b").distinct(), "graph-edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stage_table(both.groupBy("a").agg(F.min("b").alias("least"))
                              .select(F.col("a").alias("node"), F.least("a", "least").alias("parent")), "graph-parents")
        levels.append(parents)
        to = lambda c: parents.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}"))
        edges = stage_table(edges.join(to("a"), "a").join(to("b"), "b").where("pa <> pb")
                            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "graph-edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    roots = levels.pop().withColumnRenamed("parent", "root")
    while levels:
        up = roots.select(F.col("node").alias("parent"), "root")
        roots = levels.pop().join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return roots
