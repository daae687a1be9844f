"""Connected components of an undirected edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for each node with an edge. edges: (a, b) of any comparable type.

    Every step keeps the components and shortens the ways to their least nodes; it ends when all edges
    are stars. A node's neighbours are only ever reduced to their least, never gathered; a hub's edges are
    joined against a written table, so that the runtime can split them.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while True:
        # all edges are stars once no node is both a child and a root, or a child twice
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(now.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if not ends.agg(F.count_if(F.col("up") + F.col("root") > 1)).first()[0]:
            break
        # large star: from each node's greater neighbours to the least of all its neighbours and itself
        arcs = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = settle(arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
        large = settle(arcs.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b"), "components-large")
        # small star: from each node's smaller neighbours, and itself, to the least of them
        below = settle(large.groupBy("a").agg(F.min("b").alias("m")), "components-below")
        small = large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(below.select("a", F.col("m").alias("b")))
        now = settle(small.distinct(), "components")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
