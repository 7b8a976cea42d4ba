"""Words and shingles of texts as columns, for the operators that use DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, row_key, stage


def word_list(text: Column) -> Column:
    """Words of a text: runs of letters and digits, in lower case; punctuation and marks around words don't count."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of the runs of `size` words, in order; none if there are fewer words."""
    at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), at)).otherwise(F.array().cast("array<bigint>"))


def _own_shingles(patterns: DataFrame, size: int) -> DataFrame:
    """(pid, n, w, off, h): the shingles of patterns (pid, words); one of fewer words than `size` is one shingle, w words wide."""
    sized = patterns.withColumn("n", F.size("words")).where("n > 0").withColumn("w", F.least("n", F.lit(size)))
    each = [sized.where(F.col("w") == w).select("pid", "n", "w", F.posexplode(shingle_hashes(F.col("words"), w)).alias("off", "h")) for w in range(1, size + 1)]
    return reduce(DataFrame.union, each)


def _places(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(k, w, pos, h): all shingles of docs (k, words) that are one of `widths` words wide."""
    each = [docs.select("k", F.lit(w).alias("w"), F.posexplode(shingle_hashes(F.col("words"), w)).alias("pos", "h")) for w in widths]
    return reduce(DataFrame.union, each)


def anchors(docs: DataFrame, patterns: DataFrame, size: int, least: float, weights: DataFrame | None = None) -> DataFrame:
    """Where shingles of the patterns (pid, words) stand in docs (k, text): (k, pid, n, at), for each document and
    pattern that may share `least` of the pattern's shingles, or of their weights (h, w); without those, a shingle weighs
    1 / (patterns that hold it).

    at is the word of the document at which the pattern would begin if aligned there, n the pattern's words. Retrieval
    asks for a pattern's rarest shingles alone, as many as more than 1 - least of the pattern by count and by weight:
    what lacks them all can't share `least`. So a shingle that many patterns share is hardly looked up. All places are
    then taken for the pairs so found. A pattern of fewer words than `size` is one shingle of its own length."""
    own = stage(_own_shingles(patterns, size), "shingles")
    widths = [w for (w,) in own.select("w").distinct().collect()]  # at most `size` numbers
    if not widths:
        return docs.sparkSession.createDataFrame([], "k binary, pid bigint, n int, at int")
    kinds = own.select("pid", "w", "h").distinct()
    if weights is None:
        weights = kinds.groupBy("h").agg((1.0 / F.count("*")).alias("w"))
    rising, every = Window.partitionBy("pid").orderBy(F.desc("weight"), "h"), Window.partitionBy("pid")
    ranked = kinds.join(weights.select("h", F.col("w").alias("weight")), "h", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    ranked = ranked.withColumn("i", F.row_number().over(rising) - 1).withColumn("all", F.count("*").over(every))
    ranked = ranked.withColumn("before", F.sum("weight").over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight")).withColumn("total", F.sum("weight").over(every))
    slack = 1 - least + 1e-9
    rare = stage(ranked.where((F.col("i") <= F.col("all") * slack) | (F.col("before") <= F.col("total") * slack)).select("pid", "w", "h"), "rare")
    met = _places(docs.select("k", word_list(F.col("text")).alias("words")), sorted(widths)).drop("pos").join(bounded_broadcast(rare), ["w", "h"]).select("k", "pid")
    pairs = stage(met.distinct(), "pairs")
    # texts are cut into words anew, but only those of the pairs: staged first, or Spark would do it before the join
    few = stage(docs.join(bounded_broadcast(pairs.select("k").distinct()), "k").select("k", "text").dropDuplicates(["k"]), "texts")
    hit = _places(few.select("k", word_list(F.col("text")).alias("words")), sorted(widths))
    asked = pairs.join(bounded_broadcast(own), "pid")
    return asked.join(hit, ["k", "w", "h"]).select("k", "pid", "n", (F.col("pos") - F.col("off")).alias("at")).distinct()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, doc_id, text): k is a hash of the row's id and text."""
    return docs.select(row_key(id_col, text_col).alias("k"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
