"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  The edge
table only ever moves between executors; each step keeps at most as many edges as
came in.  A node with very many edges is met by a partial minimum before the
shuffle, and by a join that deals the edges of hot nodes over all tasks.

``Labels`` keeps the components of all edges seen so far.  New edges are mapped to the
components that their ends have, and only those that join two components take steps, so
a batch costs what it changes and not what was there before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.shared import hot_keys, spread_join, stored


def _star_steps(edges: DataFrame, least: DataFrame) -> DataFrame:
    """One large-star and one small-star step; ``least`` has each node's smallest neighbour (or itself) and its number of edges."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = spread_join(both.filter("v > u"), least.select("u", "m"), "u", hot_keys(least, "u", "n"))
    large = stored(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
    least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    small = spread_join(large, least.select("u", "m"), "u", hot_keys(least, "u", "n")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return small.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node."""
    stars = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    while True:
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")), "least")
        # done once a node is the smallest of its neighbours or has just one: all are stars then
        if least.filter("m < u AND n > 1").isEmpty():
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        stars = stored(_star_steps(stars, least), "stars")


class Labels:
    """Components of a growing edge table."""

    def __init__(self) -> None:
        self.table: DataFrame | None = None

    def of(self, rows: DataFrame, node: str, name: str, hot: DataFrame | None = None) -> DataFrame:
        """``rows`` with the component of their ``node`` as ``name``: the node itself where it has no edge.

        ``hot`` (node, component), a bounded table, has nodes that very many of the rows have.
        """
        if self.table is None:
            return rows.withColumn(name, F.col(node))
        if hot is not None:
            known = hot.select(F.col("node").alias("_docweft_node"), F.col("component").alias("_docweft_component"))
            sent = rows.drop(name).join(F.broadcast(known), F.col(node) == F.col("_docweft_node"), "left")
            rest = self.of(sent.filter("_docweft_node IS NULL").drop("_docweft_node", "_docweft_component"), node, name)
            return rest.unionByName(sent.filter("_docweft_node IS NOT NULL").withColumn(name, F.col("_docweft_component")).drop("_docweft_node", "_docweft_component"))
        known = self.table.select(F.col("node").alias("_docweft_node"), F.col("component").alias("_docweft_component"))
        found = rows.drop(name).join(known, F.col(node) == F.col("_docweft_node"), "left")
        return found.withColumn(name, F.coalesce("_docweft_component", node)).drop("_docweft_node", "_docweft_component")

    def add(self, edges: DataFrame) -> bool:
        """Take edges (a, b) in; False if they join nothing that was apart."""
        hot = None
        if self.table is not None:
            ends = stored(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n")), "ends")
            hot = self.of(hot_keys(ends, "node", "n").select("node"), "node", "component")
        across = self.of(self.of(edges.select("a", "b"), "a", "ca", hot), "b", "cb", hot).filter("ca != cb")
        joined = components(across, "ca", "cb")
        if joined.isEmpty():
            return False
        if self.table is not None:
            new = joined.select(F.col("node").alias("old"), F.col("component").alias("new"))
            moved = self.table.join(new, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
            joined = moved.unionByName(joined.join(self.table.select("node"), "node", "left_anti"))
        self.table = stored(joined, "labels")
        return True
