"""Connected components and spanning trees by repeated grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, release


def connected_components(nodes: DataFrame, links: DataFrame, keys: list[str] = (), id_col: str = "id") -> DataFrame:
    """(keys, id, component): the smallest id reachable over `links` (a, b).

    Each round takes the smallest neighbour label (combined on the map side) and then follows the
    label one step, so paths halve; rounds grow with the logarithm of the longest path.
    """
    keys = list(keys)
    both = links.select(*keys, "a", "b").unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.distinct())
    known = labels = cut_lineage(nodes.select(*keys, F.col(id_col).alias("id"), F.col(id_col).alias("component")))
    while True:
        seen = labels.select(*keys, F.col("id").alias("b"), F.col("component").alias("_near"))
        nearest = both.join(seen, [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("_near").alias("_near"))
        lower = labels.join(nearest, [*keys, "id"], "left").select(
            *keys, "id", F.col("component").alias("_old"), F.least("component", "_near").alias("component")
        )
        hop = lower.select(*keys, F.col("id").alias("component"), F.col("component").alias("_next"))
        jumped = lower.join(hop, [*keys, "component"], "left").select(
            *keys, "id", "_old", F.least("component", "_next").alias("component")
        )
        before, jumped = known, cut_lineage(jumped)
        known, labels = jumped, jumped.drop("_old")
        done = jumped.filter(F.col("_old") != F.col("component")).isEmpty()
        release(before)  # the rows of the round before are no longer read
        if done:
            release(both)
            return labels


def minimum_spanning_tree(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Boruvka rounds: every component picks its shortest outgoing edge, then components merge."""
    edges = cut_lineage(edges.select("id_a", "id_b", "dist"))
    labels = nodes.select(F.col(id_col).alias("id"), F.col(id_col).alias("component"))
    tree = None
    while True:
        left = labels.select(F.col("id").alias("id_a"), F.col("component").alias("_ca"))
        right = labels.select(F.col("id").alias("id_b"), F.col("component").alias("_cb"))
        crossing = edges.join(left, "id_a").join(right, "id_b").filter(F.col("_ca") != F.col("_cb"))
        pick = F.struct("dist", "id_a", "id_b", "_ca", "_cb")
        ends = crossing.select(F.col("_ca").alias("c"), pick.alias("e")).unionByName(crossing.select(F.col("_cb").alias("c"), pick.alias("e")))
        chosen = cut_lineage(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        if chosen.isEmpty():
            return tree
        new = chosen.select("id_a", "id_b", "dist")
        tree = new if tree is None else cut_lineage(tree.unionByName(new).distinct())
        names = labels.select("component").distinct()
        merged = connected_components(names, chosen.select(F.col("_ca").alias("a"), F.col("_cb").alias("b")), id_col="component")
        merged = merged.select(F.col("id").alias("component"), F.col("component").alias("_to"))
        labels = cut_lineage(labels.join(merged, "component").select("id", F.col("_to").alias("component")))
