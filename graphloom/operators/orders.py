"""The orders in which lists are shown. Each ends with an id or the whole key, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import staged

#: Candidates shown for a new link of an item (fixed value).
CANDIDATES = 8


def _newest(name: str) -> list[Column]:
    return [F.desc("updated_at"), F.lower(name), F.col("id")]


REPOSITORIES, COLLECTIONS = (lambda: _newest("display_name")), (lambda: _newest("title"))


def ITEMS() -> list[Column]:
    return [F.col("collection_id"), F.col("sort_order"), F.col("id")]


def FILES() -> list[Column]:
    return [F.lower("relative_path"), F.col("relative_path")]


def AFFECTED_CALLERS() -> list[Column]:
    return [F.col("distance"), F.col("fqn"), F.col("relative_path"), F.col("symbol_id")]


def ordered(order, rows: DataFrame) -> DataFrame:
    """rows in one of the orders: a sort by ranges, over all tasks."""
    return rows.orderBy(*order())


def placed(order, rows: DataFrame) -> DataFrame:
    """rows with their place (from 1) in one of the orders.

    Places come from the sorted ranges: rows are numbered within a range, and ranges are offset by the rows before."""
    ranged = staged(ordered(order, rows).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    many = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a range
    before = many.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    met = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
    return met.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_at")


def relink_candidates(symbols: DataFrame, query: str | None, captured_fqn: str) -> DataFrame:
    """The first candidates of a substring search for the query, by default the captured name."""
    from .search import search_substring

    return search_substring(symbols, captured_fqn if query is None else query, CANDIDATES)
