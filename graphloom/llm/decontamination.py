"""Benchmark decontamination: SimHash of item-sized windows, a multi-index Hamming join, exact verification.

DataFrame functions only. Documents and items that can't reach the similarity are ruled out by the item's rarest
shingles (see anchors); for the pairs that are left, windows are placed at every five-word shingle that the document
shares with the item, aligned so that the window is item-sized. A window that shares none has similarity 0; one that
stands between two such alignments isn't made, so a passage with words put in is found by its longer part. Repeated
items are one item until the end. Windows and items get two 64-bit
SimHashes, of their shingles and of their weighted shingles; an item's shingle weighs 1 / (items that hold it), any
other 1. The index cuts fingerprints into 6 blocks; two fingerprints within RADIUS = 17 agree in some block up to two
bits (6 * 3 = 18), and all values of an item's block within two bits are enumerated, so equal (length, block, value)
retrieves every pair within the radius by either fingerprint. At similarity 0.8 a pair lies beyond it in about one of
200 cases, at 0.85 in one of 3000. Retrieved pairs are verified by exact Jaccard similarity of the two shingle sets,
the greater of plain and weighted: weights alone would let items that share a text outvote their own copies.

The benchmark side is broadcast if its counted size is bounded, and joined by shuffles otherwise.

Defined results: null and empty texts match nothing; an item with fewer than five words is one shingle, so it must
stand whole in the document; an item without words matches nothing; repeated documents are reported each, once for an
item (its best window, then the first); repeated items are reported by their id each; empty tables give empty ones.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, kept, row_key, scratch, stage
from .native_text import anchors, keyed, shingle_hashes, word_list

#: Bits of the index's blocks, and the largest distance that it guarantees to find.
BLOCKS = (11, 11, 11, 11, 10, 10)
RADIUS = 3 * len(BLOCKS) - 1


def simhash(items: Column) -> Column:
    """64 bits: the sign of the weighted vote of the shingles' bits. items: array of struct (h, w)."""
    def bit(b: Column) -> Column:
        vote = F.aggregate(items, F.lit(0.0), lambda a, s: a + F.when(F.getbit(s["h"], b) == 1, s["w"]).otherwise(-s["w"]))
        return F.when(vote > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def fingerprints(weighted: Column) -> dict[str, Column]:
    """f of the shingles alone and wf of the weighted shingles. weighted: array of struct (h, w)."""
    return {"f": simhash(F.transform(weighted, lambda s: F.struct(s["h"].alias("h"), F.lit(1.0).alias("w")))), "wf": simhash(weighted)}


def _block_values(h: Column) -> list[Column]:
    out, shift = [], 0
    for bits in BLOCKS:
        out.append(F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)))
        shift += bits
    return out


def window_keys(h: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), v.alias("value")) for i, v in enumerate(_block_values(h))])


def item_keys(h: Column) -> Column:
    """Every block's value with all changes of at most two bits."""
    def near(i: int, bits: int, v: Column) -> Column:
        masks = [0, *(1 << a for a in range(bits)), *((1 << a) | (1 << b) for a, b in combinations(range(bits), 2))]
        return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(F.lit(i).alias("block"), v.bitwiseXOR(m).alias("value")))

    return reduce(F.concat, [near(i, bits, v) for i, (bits, v) in enumerate(zip(BLOCKS, _block_values(h), strict=True))])


def _sets(rows: DataFrame, size: int) -> Column:
    """Distinct shingle hashes of column words; a short list is one shingle."""
    whole = F.array(F.xxhash64(F.array_join("words", "\x01")))
    return F.when(F.size("words") < size, whole).otherwise(F.array_distinct(shingle_hashes(F.col("words"), size)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, k, item_id, start_word, hamming, similarity) for each document and item whose texts are that similar."""
    with scratch(docs.sparkSession):
        named = benchmark.select(F.col(item_col).alias("item_id"), word_list(F.col(item_text)).alias("words")).where(F.size("words") > 0)
        named = stage(named.withColumn("t", F.md5(F.array_join("words", " "))), "named")
        items = named.groupBy("t").agg(F.min("words").alias("words")).select(F.monotonically_increasing_id().alias("pid"), "t", "words")
        items = stage(items.withColumn("n", F.size("words")).withColumn("set", _sets(items, size)), "items")
        names = named.select("t", "item_id").join(items.select("t", "pid"), "t").select("pid", "item_id")
        holders = names.groupBy("pid").agg(F.count("*").alias("c"))
        each = items.select("pid", F.explode("set").alias("h"))
        weights = stage(each.join(holders, "pid").groupBy("h").agg((1.0 / F.sum("c")).alias("w")), "weights")
        weighed = each.join(weights, "h").groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("h", "w"))).alias("ws"))
        items = stage(items.join(weighed, "pid").withColumns(fingerprints(F.col("ws"))).select("pid", "n", "set", "ws", "f", "wf", "words"), "items")

        base = keyed(docs, id_col, text_col)
        found = stage(anchors(base.select("k", "text"), items.select("pid", "words"), size, similarity, weights), "anchors")
        wanted = stage(found.select("k").distinct(), "wanted")
        hit = stage(base.join(bounded_broadcast(wanted), "k").select("k", "doc_id", word_list(F.col("text")).alias("all")), "hit")
        spots = found.select("k", "n", F.greatest("at", F.lit(0)).alias("at")).distinct()
        windows = hit.dropDuplicates(["k"]).join(spots, "k").withColumn("words", F.slice("all", F.col("at") + 1, F.col("n"))).where(F.size("words") > 0)
        windows = windows.select("k", "n", "at", "words").withColumn("set", _sets(windows, size))
        parts = windows.select("k", "n", "at", F.explode("set").alias("h")).join(bounded_broadcast(weights), "h", "left")
        parts = parts.groupBy("k", "n", "at").agg(F.collect_list(F.struct("h", F.coalesce("w", F.lit(1.0)).alias("w"))).alias("ws"))
        parts = stage(parts.withColumns(fingerprints(F.col("ws"))), "windows")

        either = lambda keys: F.explode(F.array_distinct(F.concat(keys(F.col("f")), keys(F.col("wf"))))).alias("key")
        index = items.select("pid", "n", F.col("f").alias("g"), F.col("wf").alias("wg"), either(item_keys))
        index = index.select("pid", "n", "g", "wg", "key.block", "key.value")
        asked = parts.select("k", "n", "at", "f", "wf", either(window_keys)).select("k", "n", "at", "f", "wf", "key.block", "key.value")
        far = F.least(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))), F.bit_count(F.col("wf").bitwiseXOR(F.col("wg"))))
        pairs = asked.join(bounded_broadcast(index), ["n", "block", "value"]).where(far <= RADIUS).select("k", "n", "at", "pid", far.alias("hamming")).distinct()
        sums = lambda c: F.aggregate(c, F.lit(0.0), lambda a, s: a + s["w"])
        both = pairs.join(parts.select("k", "n", "at", "ws"), ["k", "n", "at"]).join(bounded_broadcast(items.select("pid", F.col("ws").alias("is"), "set")), "pid")
        common = both.withColumn("common", F.filter("ws", lambda s: F.array_contains(F.col("set"), s["h"])))
        jaccard = lambda total: total(F.col("common")) / (total(F.col("ws")) + total(F.col("is")) - total(F.col("common")))
        scored = common.withColumn("similarity", F.round(F.greatest(jaccard(F.size), jaccard(sums)), 6))
        best = scored.where(F.col("similarity") >= similarity).groupBy("k", "pid").agg(F.max(F.struct("similarity", -F.col("at"), -F.col("hamming"))).alias("t"))
        best = best.join(names, "pid").select("k", "item_id", (-F.col("t.col2")).alias("start_word"), (-F.col("t.col3")).alias("hamming"), "t.similarity")
        leaks = hit.select("k", "doc_id").join(bounded_broadcast(stage(best, "best")), "k").select("doc_id", "k", "item_id", "start_word", "hamming", "similarity")
        return kept(stage(leaks, "leaks"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no passage of the benchmark, with all their columns."""
    with scratch(docs.sparkSession):
        found = contaminated(docs, benchmark, id_col, text_col, **options)
        marks = kept(stage(found.select(F.col("k").alias("_mark")).distinct(), "leaked"))
    return docs.join(bounded_broadcast(marks), row_key(id_col, text_col) == marks["_mark"], "left_anti")
