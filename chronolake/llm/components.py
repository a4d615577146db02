"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is a partial aggregation and an equi-join, so a hub with a third of all edges is combined
before it is shuffled and its join partition can be split.  Each step is stored, as the next reads it two
or three times, which would make one plan of many joins on the driver.  Nothing is collected but whether
the edges are stars, which no step changes, so no round is run to see that nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Expects u > v in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either the lesser end of all its edges or the greater end of one edge.  Expects u > v in every edge."""
    end = lambda node, up: edges.select(F.col(node).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    nodes = end("u", 1).union(end("v", 0)).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up + down > 1").isEmpty()


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that has a link; the component is its least node.

    Links with a null end, links of a node with itself and repeated links have no effect on the
    partition; an empty table gives an empty table.  Node columns may be of any ordered type.
    """
    a, b = F.col(u), F.col(v)
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(edges, "links")
    while not _are_stars(edges):
        edges = written(_small_star(written(_large_star(edges), "large")), "links")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
