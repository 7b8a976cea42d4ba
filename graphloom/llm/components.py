"""Connected components of an edge table, by alternating large and small stars over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v.

    Large: every neighbour above a node is tied to the node's least neighbour (or itself). Small: a node and its
    lesser neighbours are tied to the least of them. Neither changes the components."""
    if large:
        edges = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    met = edges.join(least, edges.u == least.n).select("u", "v", "m")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("n", "m"))
    return out.where("u != v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node on an edge a-b; component is the least node that can be reached.

    Null ends and loops take no part; an empty table gives an empty one. Work a round is a few aggregations over the
    edges, hot nodes are pre-aggregated and their join can be split; the rounds grow as the log of the longest chain."""
    now = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    facts = None
    while True:
        seen = now.agg(F.count("*"), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == facts or seen[0] == 0:
            break
        if facts is not None and seen[0] == seen[1] and not now.select(F.col("v").alias("u")).join(now.select("u"), "u", "left_semi").take(1):
            break  # every node hangs on one root
        facts = seen
        now = stage(_star(_star(now, True), False), "edges")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(ends.select(F.col("component").alias("node"), "component").distinct())
