"""Connected components of a graph that no one machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.session import settle


def _to_smallest(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Link what is next to each node to the smallest node among them and itself.

    ``edges`` holds ``(u, v)``, with every edge in both directions unless ``smaller_only``, which
    keeps those that lead to a smaller node. The minimum is combined before the shuffle and
    joined back from a stored table, so that adaptive execution can split a node with very many edges.
    """
    least = settle(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    linked = edges.join(least, "u")
    if smaller_only:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where(F.col("u") != F.col("v"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; a component is its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (SoCC 2014) until every edge
    points at a component's smallest node. Each round is written to the scratch folder, so that
    a lost executor costs one round. Nodes without edges are not listed. Self links and repeated
    or reversed edges are allowed; an empty table gives an empty table.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    pairs = settle(pairs, "edges")
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(_to_smallest(both, smaller_only=False).distinct(), "large-star")
        small = settle(_to_smallest(large, smaller_only=True).distinct(), "small-star")
        # Done when no node but roots is pointed at: then every edge leads to a root.
        roots = small.select(F.col("v").alias("u")).distinct()
        done = small.join(roots, "u", "left_semi").isEmpty()
        same_size = done and small.groupBy("u").count().where("count > 1").isEmpty()
        pairs = small
        if same_size:
            break
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())
