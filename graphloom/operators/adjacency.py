"""The kept adjacency: both directions of every edge, in folders by the node they are asked for.

A node's rows lie in one folder (bucket), sorted by node over files of disjoint ranges, with the whole edge in each row. So
a hop reads the folders of its frontier's nodes, and of these the row groups that may hold them, whatever the size of the
edge table; edges without a target have their caller's row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staged import staged
from .graph import clamp_depth, induced_subgraph

#: Rows that a bucket is meant for, and the most buckets; larger ones have more files.
ROWS, MOST = 1 << 17, 4096
#: Frontiers of up to so many nodes are also named to the reader, which then passes over row groups.
NAMED = 64


def bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def write(folder: str, edges: DataFrame, rows: int = ROWS) -> dict:
    """Write the adjacency of edges; what is returned (folder, buckets, schema) opens it again."""
    buckets = max(1, min(MOST, -(-2 * edges.count() // rows)))
    there = edges.withColumns({"node": F.col("caller_symbol_id"), "other": F.col("callee_symbol_id")})
    back = edges.where("callee_symbol_id is not null").withColumns({"node": F.col("callee_symbol_id"), "other": F.col("caller_symbol_id")})
    both = there.unionByName(back).withColumn("bucket", bucket(F.col("node"), buckets))
    # ranges by edge too: a hub's rows are shared among tasks
    both.repartitionByRange("bucket", "node", "edge_id").sortWithinPartitions("bucket", "node", "edge_id").write.partitionBy("bucket").parquet(folder)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields)
    return {"folder": folder, "buckets": buckets, "schema": schema}


def touching(spark: SparkSession, kept: dict, nodes: DataFrame) -> DataFrame:
    """The kept rows of nodes (column node): read from the buckets of these nodes alone."""
    wanted = [r.b for r in nodes.select(bucket(F.col("node"), kept["buckets"]).alias("b")).distinct().collect()]  # at most MOST numbers
    if not wanted:
        return spark.createDataFrame([], kept["schema"])
    rows = spark.read.schema(kept["schema"]).parquet(kept["folder"]).where(F.col("bucket").isin(wanted))
    few = [r.node for r in nodes.select("node").limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        return rows.where(F.col("node").isin(few))
    return rows.join(nodes.select("node"), "node", "left_semi")


def neighbourhood(spark: SparkSession, kept: dict, symbols: DataFrame, root: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a symbol, as graph.neighbourhood gives them; each level's rows are read once."""
    frontier = symbols.where(F.col("symbol_id") == root).select(F.col("symbol_id").alias("node")).distinct()
    seen, found = frontier.withColumn("distance", F.lit(0)), []
    for d in range(1, clamp_depth(depth) + 1):
        level = staged(touching(spark, kept, frontier), "level")
        found.append(level.drop("node", "other", "bucket"))
        step = level.where("other is not null").select(F.col("other").alias("node")).distinct()
        frontier = staged(step.join(seen.select("node"), "node", "left_anti"), "frontier")
        seen = seen.union(frontier.withColumn("distance", F.lit(d)))
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    nodes = symbols.join(seen, symbols["symbol_id"] == seen["node"]).drop("node")
    return nodes, edges.dropDuplicates(["edge_id"])


def discovered_graph(spark: SparkSession, kept: dict, symbols: DataFrame, root: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """As neighbourhood, but of edges only those with both ends among the nodes."""
    nodes, edges = neighbourhood(spark, kept, symbols, root, depth)
    return nodes, induced_subgraph(edges, nodes.select(F.col("symbol_id").alias("node")))
