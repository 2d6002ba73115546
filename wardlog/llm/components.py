"""Connected components of an edge table, by smallest labels and pointer jumping; roots of a forest, by jumping alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.session import scratch, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of undirected edges (a, b); the label is the smallest node reachable.

    Each round takes the smallest label among the neighbours and then the label of that label, so long chains shorten by
    halves. Rounds are written to the shared folder, which cuts the lineage; only the number of changes reaches the driver.
    """
    with scratch(edges.sparkSession):
        both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
        while True:
            of_neighbour = labels.select(F.col("node").alias("b"), "label")
            nearest = both.join(of_neighbour, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("nearest"))
            moved = labels.join(nearest, "node").select("node", F.col("label").alias("old"), F.least("label", "nearest").alias("label"))
            target = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            after = stage(moved.join(target, "label").select("node", "old", F.least("label", "next").alias("label")), "labels", keep=True)
            labels = after.select("node", "label")
            if not after.where("label <> old").count():
                return labels


def roots(links: DataFrame) -> DataFrame:
    """(node, label) of every child in a forest of links from parent a to child b; a child has one parent, smaller than itself.

    Each round replaces a node's parent by the parent's parent, so depths halve; no edge is read twice in a round. Roots
    are no children and have no row.
    """
    with scratch(links.sparkSession):
        up = stage(links.select(F.col("b").alias("node"), F.col("a").alias("label")), "parents", keep=True)
        while True:
            above = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
            up = stage(up.join(above, "label", "left").select("node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")), "parents", keep=True)
            if up.where("moved").isEmpty():
                return up.select("node", "label")
            up = up.select("node", "label")


def merged(labels: DataFrame, above: DataFrame) -> DataFrame:
    """(node, label) of two levels: components of nodes, and components of their labels; a node without a row is its own label."""
    onto = above.select(F.col("node").alias("label"), F.col("label").alias("top"))
    lower = labels.join(onto, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return lower.union(above.join(labels.select("node"), "node", "left_anti").select("node", "label"))
