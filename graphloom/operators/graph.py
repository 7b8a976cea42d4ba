"""Neighbourhoods, induced subgraphs and reverse reachability, as at most three joins over frontiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staged import staged
from .orders import placed

MAX_DEPTH = 3


def clamp_depth(depth: int) -> int:
    return max(1, min(MAX_DEPTH, int(depth)))


def links_of(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, of edges with a target."""
    known = edges.where(F.col("callee_symbol_id").isNotNull())
    there = known.select(F.col("caller_symbol_id").alias("a"), F.col("callee_symbol_id").alias("b"))
    return there.union(there.select("b", "a"))


def distances(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, distance): least number of links from any of the roots (column node), up to depth."""
    links = links_of(edges).distinct().persist()  # each level joins it; lost blocks are computed anew
    seen = roots.select("node").distinct().withColumn("distance", F.lit(0)).persist()
    frontier = seen
    for d in range(1, clamp_depth(depth) + 1):
        step = frontier.join(links, frontier["node"] == links["a"]).select(F.col("b").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)).persist()
        seen = seen.union(frontier)
    return seen


def neighbourhood(symbols: DataFrame, edges: DataFrame, root: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a symbol. Every edge that touches a node short of the last level is kept, edges without a
    target too; those among nodes of the last level aren't. An unknown root gives no node and no edge."""
    depth, edges = clamp_depth(depth), edges.persist()
    roots = symbols.where(F.col("symbol_id") == root).select(F.col("symbol_id").alias("node"))
    seen = distances(edges, roots, depth)
    nodes = symbols.join(seen, symbols["symbol_id"] == seen["node"]).drop("node")
    inner = seen.where(F.col("distance") < depth).select("node")
    out = edges.join(inner, edges["caller_symbol_id"] == inner["node"], "left_semi").union(edges.join(inner, edges["callee_symbol_id"] == inner["node"], "left_semi"))
    return nodes, out.dropDuplicates(["edge_id"])


def discovered_graph(symbols: DataFrame, edges: DataFrame, root: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """As neighbourhood, but of edges only those with both ends among the nodes."""
    nodes, touching = neighbourhood(symbols, edges, root, depth)
    return nodes, induced_subgraph(touching, nodes.select(F.col("symbol_id").alias("node")))


def discovery_order(symbols: DataFrame, edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(symbol_id, distance, place): the nodes of discovered_graph in the order in which a search from the root finds them.

    A search takes nodes in the order of their finding, and each node's edges in order of edge_id. So a node's rank is the
    edges by which it is first found, from the root on: the least rank of a parent, then the edge's place. Ranks are at
    most MAX_DEPTH numbers long, go along with the frontier, and are sorted by ranges at the end."""
    known = edges.where(F.col("callee_symbol_id").isNotNull())
    there = known.select(F.col("caller_symbol_id").alias("a"), F.col("callee_symbol_id").alias("b"), "edge_id")
    links = there.union(there.select("b", "a", "edge_id"))
    seen = symbols.where(F.col("symbol_id") == root).select(F.col("symbol_id").alias("node"), F.lit(0).alias("distance"), F.array().cast("array<bigint>").alias("rank")).distinct()
    frontier = seen
    for d in range(1, clamp_depth(depth) + 1):
        step = frontier.join(links, frontier["node"] == links["a"]).groupBy(F.col("b").alias("node")).agg(F.min(F.concat("rank", F.array("edge_id"))).alias("rank"))
        frontier = staged(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("distance"), "rank"), "frontier")
        seen = seen.union(frontier)
    alive = seen.join(symbols.select(F.col("symbol_id").alias("node")).distinct(), "node", "left_semi")
    return placed(lambda: [F.col("distance"), F.col("rank")], alive).select(F.col("node").alias("symbol_id"), "distance", "place")


def induced_subgraph(edges: DataFrame, ids: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The edges with both ends among ids (column node); repeated calls stay apart.

    by: columns of ids that name several sets of nodes; then an edge is given for each set that holds both its ends."""
    ids = ids.select(*(by or []), "node").distinct()
    if not by:
        return edges.join(ids, edges["caller_symbol_id"] == ids["node"], "left_semi").join(ids, edges["callee_symbol_id"] == ids["node"], "left_semi")
    inner = edges.join(ids.withColumnRenamed("node", "caller_symbol_id"), "caller_symbol_id")
    return inner.join(ids.withColumnRenamed("node", "callee_symbol_id"), [*by, "callee_symbol_id"], "left_semi")


def numbered(seeds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(seed, word, bit): a number for each distinct seed, as one bit of one of many 64-bit words.

    by: columns of seeds to number them by, so that seeds that lie together, which mostly share callers, share words."""
    firsts = [F.min(c).alias(c) for c in by or []]
    once = seeds.groupBy("seed").agg(*firsts) if firsts else seeds.select("seed").distinct()
    at = F.col("place") - 1
    found = placed(lambda: [*map(F.col, by or []), F.col("seed")], once.where("seed is not null"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(64)).cast("int"))
    return staged(found.select("seed", F.shiftright(at, 6).alias("word"), bit.alias("bit")), "seeds")


def callers(edges: DataFrame) -> DataFrame:
    """(to, by): the distinct callers of each symbol, written once for all levels."""
    return staged(edges.where(F.col("callee_symbol_id").isNotNull()).select(F.col("callee_symbol_id").alias("to"), F.col("caller_symbol_id").alias("by")).distinct(), "callers")


def reverse_sets(back: DataFrame, seeds: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(node, word, bits, distance): the seeds (see numbered) that each node first reaches at a distance, as bits of words.

    A node has a row for each word that it reaches, not for each seed, and bits that meet at a node are merged before
    and after the shuffle; so a hub that reaches all seeds hands on a sixty-fourth of their number."""
    seen = seeds.select(F.col("seed").alias("node"), "word", F.col("bit").alias("bits"))
    frontier, levels = seen, []
    for d in range(1, clamp_depth(depth) + 1):
        step = frontier.join(back, frontier["node"] == back["to"]).groupBy(F.col("by").alias("node"), "word").agg(F.bit_or("bits").alias("reached"))
        fresh = F.col("reached").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("bigint"))))
        met = step.join(seen, ["node", "word"], "left").select("node", "word", fresh.alias("bits")).where("bits <> 0")
        frontier = staged(met, "frontier")
        seen = seen.union(frontier).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))
        levels.append(frontier.withColumn("distance", F.lit(d)))
    return reduce(DataFrame.union, levels)


def seeds_of(sets: DataFrame, seeds: DataFrame) -> DataFrame:
    """sets with a column of the seeds that its bits stand for: at most 64 a row."""
    words = seeds.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("seed", "bit"))).alias("_own"))
    met = sets.join(words, "word")
    return met.withColumn("seeds", F.transform(F.filter("_own", lambda x: x["bit"].bitwiseAND(F.col("bits")) != 0), lambda x: x["seed"])).drop("_own")


def reverse_reach(edges: DataFrame, seeds: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(seed, node, distance): callers of each seed, transitively, at their least distance from it."""
    names = numbered(seeds)
    return seeds_of(reverse_sets(callers(edges), names, depth), names).select(F.explode("seeds").alias("seed"), "node", "distance")
