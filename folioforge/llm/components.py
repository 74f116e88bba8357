"""Connected components of a graph of links, in tables only: large-star and small-star in turn until only stars are left.

Every step joins edges with the least neighbour of a node, both read from the shared folder, so that the join of a
node with very many edges can be split. Nothing of the graph comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b) of longs: the component is its least node. Nodes without links to others are left out."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        # stars: every node has one edge, and to no node that has one itself
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("is_end")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("is_end")))
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("is_end").alias("is_end")).where("out > 1 OR out = 1 AND is_end = 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
