"""Differences between two analysed revisions, and the unchanged callers they reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import staged
from .graph import callers, numbered, reverse_sets, seeds_of

KEY = ["repository_id", "language", "fqn", "signature"]
#: Kinds of change, in the order of reports (fixed values).
KINDS = ("added", "modified", "deleted", "moved")


def by_key(symbols: DataFrame) -> DataFrame:
    """One symbol a key: of several, the last by path and id."""
    last = F.max(F.struct("relative_path", "symbol_id", "ast_fingerprint")).alias("s")
    return symbols.groupBy(*KEY).agg(last).select(*KEY, "s.*")


def diff_symbols(base: DataFrame, current: DataFrame) -> DataFrame:
    """(repository_id, language, fqn, signature, kind, base_id, current_id, base_path, current_path) of every changed key.

    Another path is moved, whatever the fingerprint; else another fingerprint is modified."""
    sides = []
    for name, df in (("base", base), ("current", current)):
        s = by_key(df)
        sides.append(s.select(*KEY, *[F.col(a).alias(f"{name}_{b}") for a, b in (("symbol_id", "id"), ("relative_path", "path"), ("ast_fingerprint", "print"))]))
    met = sides[0].join(sides[1], KEY, "full_outer")
    kind = F.when(F.col("base_id").isNull(), "added").when(F.col("current_id").isNull(), "deleted").when(F.col("base_path") != F.col("current_path"), "moved").when(F.col("base_print") != F.col("current_print"), "modified")
    return met.withColumn("kind", kind).where("kind is not null").select(*KEY, "kind", "base_id", "current_id", "base_path", "current_path")


def diff_files(base: DataFrame, current: DataFrame) -> DataFrame:
    """Paths whose content differs or that exist on one side only."""
    key = ["repository_id", "relative_path"]
    a, b = (df.select(*key, F.col("content_fingerprint").alias(n)) for df, n in ((base, "a"), (current, "b")))
    return a.join(b, key, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*key)


def affected_callers(changes: DataFrame, base: DataFrame, base_edges: DataFrame, current: DataFrame, current_edges: DataFrame, depth: int = 3) -> DataFrame:
    """(repository_id, symbol_id, fqn, relative_path, distance, seeds): unchanged callers within `depth` calls of a change.

    A deleted symbol's callers are sought in the base graph, others' in the current one; the way may lead through
    changed callers, but only callers that both revisions hold alike are reported."""
    changes = staged(changes, "changes")
    gone = changes.where("kind = 'deleted'").select(F.col("base_id").alias("seed"), F.col("base_path").alias("path"))
    rest = changes.where("kind <> 'deleted'").select(F.col("current_id").alias("seed"), F.col("current_path").alias("path"))
    names = numbered(gone.union(rest), ["path"])
    back = callers(base_edges)
    ahead = back if base_edges.sameSemantics(current_edges) else callers(current_edges)
    reach = lambda links, ids: reverse_sets(links, names.join(ids, "seed", "left_semi"), depth)
    named = lambda sets, symbols: sets.join(symbols.select(F.col("symbol_id").alias("node"), *KEY, "relative_path", "ast_fingerprint"), "node")
    found = named(reach(back, gone), base).union(named(reach(ahead, rest), current))
    found = found.join(changes.select(*KEY).distinct(), KEY, "left_anti")
    now = by_key(current).select(*KEY, "symbol_id", F.col("relative_path").alias("p"), F.col("ast_fingerprint").alias("f"))
    same = found.join(now, KEY).where((F.col("relative_path") == F.col("p")) & (F.col("ast_fingerprint") == F.col("f")))
    who = ["repository_id", "symbol_id", "fqn", "relative_path"]
    merged = same.groupBy(*who, "word").agg(F.bit_or("bits").alias("bits"), F.min("distance").alias("distance"))
    return seeds_of(merged, names).groupBy(*who).agg(F.min("distance").alias("distance"), F.array_sort(F.flatten(F.collect_list("seeds"))).alias("seeds"))


def impact_status(has_baseline: bool, files: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: noBaseline, changed or unchanged, with the counts."""
    n = files.agg(F.count("*").alias("changed_files")).join(changes.agg(F.count("*").alias("changes")))
    state = F.when(F.lit(not has_baseline), "noBaseline").when((F.col("changed_files") > 0) | (F.col("changes") > 0), "changed").otherwise("unchanged")
    return n.select(state.alias("status"), "changed_files", "changes")


def report_order(changes: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return changes.orderBy("fqn", F.coalesce("current_path", "base_path"), rank)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest committed run of each repository."""
    done = runs.where(F.col("status").isin("completed", "partial") & F.col("completed_at").isNotNull())
    w = Window.partitionBy("repository_id").orderBy(F.desc("id"))
    return done.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
