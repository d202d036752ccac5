"""Connected components of a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltascope.llm import common


def components(links: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 200) -> DataFrame:
    """node, component: the smallest node that each linked node reaches. Nodes without links are not listed.

    In a round every node hangs itself and its larger neighbours below the smallest neighbour, then every
    node hangs its smaller neighbours below their smallest (large star and small star); the number of links
    never grows and the rounds grow with the logarithm of the nodes. Each step only takes the smallest
    neighbour of a node, a sum that is made before rows are dealt out, so a node with many links is no burden
    to one task. Links are written to the shared folder after each round.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a != b")
    edges = common.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.unionByName(lowest.where("low < a").select("a", F.col("low").alias("b"))).where("a != b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(root, "a")
        small = small.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(root.select("a", F.col("low").alias("b"))).distinct()
        following = common.stored(small, "links")
        # Done when every node has one parent and no parent has one.
        parents = following.select(F.col("b").alias("a")).distinct()
        counts = following.agg(F.count("*").alias("links"), F.countDistinct("a").alias("nodes")).first()
        edges = following
        if counts.links == counts.nodes and not following.join(parents, "a", "left_semi").take(1):
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    raise RuntimeError(f"no stable components after {most_rounds} rounds")


def same_id_links(members: DataFrame, id_col: str, node_col: str = "node") -> DataFrame:
    """a, b: links that join all nodes of one id. members: a row for each id and node, in any number."""
    lowest = members.groupBy(id_col).agg(F.min(node_col).alias("b"), F.max(node_col).alias("top")).where("b < top").drop("top")
    return members.join(lowest, id_col).where(F.col(node_col) != F.col("b")).select(F.col(node_col).alias("a"), "b").distinct()
