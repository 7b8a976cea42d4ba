"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Size of a document: its words. The sources share the words of the whole corpus by weight, each up to a multiple of its
own size (water filling: the sources that stop at their limit are a prefix in order of limit per weight, so running
sums find the level in one pass). Within a source, whole epochs come first: a document is taken floor(target / size of
source) times. The remainder is a weighted sample without replacement: a document's key is -ln(u) / w with u from a hash
of its id and w its quality weight, so that the keys fall as u ** (1 / w) rises, without underflow where w is small;
keys are taken from the least until the words left are used up, and the document at the border is taken if that comes
nearer to the target.

No source is sorted in one task: the budget's border is found as radix digits of the key's logarithm (two levels of 256
bins whose word totals are pre-aggregated, 512 bins to a doubling), and only documents of the border bin are sorted. What comes out is one row a source, its
cut: the last document that is taken once more. Every document is held against its source's cut where it stands, so no
document is shuffled.

Defined results: null text has size 0 and is taken 0 words; a null source is a source of its own, last in order; a null
doc_id's key comes from its text; rows of equal id and text are taken together; a quality that is null or not positive
counts as the least positive weight; an empty table gives an empty one. Reruns agree, as keys depend on seed, id and
quality alone (on the text for null ids). Other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits_broadcast, kept, row_key, scratch, stage

#: Fixed weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
EPOCHS = 3
_BINS = 256
#: Parts of a source's rows where sources are too many to be broadcast.
_SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def lexical_quality(text: Column, size: Column) -> Column:
    """A quality weight from 0.5 to 1: nearer to 1 the nearer a text's characters a word are to seven."""
    chars = F.coalesce(F.length(text), F.lit(0)).cast("double")
    return F.when(chars > 0, chars / (chars + F.least(chars, F.abs(chars - size * 7.0)))).otherwise(0.5)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row a source, so the windows hold sources only."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    every = Window.partitionBy()
    before = lambda c: F.sum(c).over(fill) - F.col(c)
    level = ranked.withColumn("left", F.sum("source_size").over(every) - before("cap")).withColumn("wide", F.sum("w").over(every) - before("w"))
    full = F.col("cap") * F.col("wide") <= F.col("left") * F.col("w")
    level = level.withColumn("open", ~full).withColumn("at", F.min(F.when(~full, F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"), "left", "wide"))).over(every))
    target = F.when(F.col("open"), F.col("at.left") * F.col("w") / F.col("at.wide")).otherwise(F.col("cap").cast("double"))
    return level.select("source", "source_size", target.cast("double").alias("target"))


def sampling_key(seed: str, name: Column, quality: Column) -> Column:
    """-ln(u) / w, above 0: the smaller, the earlier a document is taken. name: what tells documents apart."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), name)), 1, 12), 16, 10).cast("double")
    u = (bits + 0.5) / float(1 << 48)
    return -F.log(u) / F.when(quality > 0, quality).otherwise(1e-3)


def _bin(key: Column) -> Column:
    """0 to 65535, rising with the key: 512 bins to a doubling, from 2**-64 to 2**64."""
    return F.greatest(F.lit(0.0), F.least(F.lit(65535.0), F.floor((F.log2(key) + 64) * 512))).cast("int")


def _at_source(rows: DataFrame, source: Column, part: Column, side: DataFrame, how: str = "left") -> DataFrame:
    """rows with the columns of side, which has one row a source (src): broadcast, or in salted parts if too large."""
    if fits_broadcast(side):
        return rows.join(F.broadcast(side), source.eqNullSafe(side["src"]), how)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.join(salted, source.eqNullSafe(salted["src"]) & (F.pmod(F.xxhash64(part), F.lit(_SALTS)) == salted["_salt"]), how).drop(salted["_salt"])


def _facts(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality_col: str | None, seed: str, *own: Column) -> DataFrame:
    """(own .., doc_id, k, source, size, key): what mixing knows of a document. Words are counted once."""
    text = F.col("_text")
    quality = F.col("_quality").cast("double") if quality_col else lexical_quality(text, F.col("size"))
    named = docs.select(*own, F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("k"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.col(text_col).alias("_text"), *([F.col(quality_col).alias("_quality")] if quality_col else []))
    key = sampling_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.hex("k")), F.col("_q"))
    return named.withColumn("_q", quality).withColumn("key", key).drop("_q", "_text", "_quality")


def _cuts(slim: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """(src, source_size, target, times, cut) by source, from (doc_id, k, source, size, key) of all documents.

    cut: (key, doc_id, size, k) of the last document taken once more than `times`, null if there is none."""
    rows = slim.withColumn("bin", _bin(F.col("key")))
    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budgets = targets.withColumn("times", whole).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))
    budgets = stage(budgets.withColumnRenamed("source", "src"), "targets")

    def border(bins: DataFrame, known: DataFrame) -> DataFrame:
        """For each source the bin in which its budget ends, and the words of all bins before. bins: (source, b, s)."""
        w = Window.partitionBy("src").orderBy("b")
        met = bins.join(known, bins["source"].eqNullSafe(known["src"])).withColumn("before", F.sum("s").over(w) - F.col("s") + F.col("spent"))
        return met.where("before < rest").groupBy("src").agg(F.max(F.struct("b", "before")).alias("t")).select("src", "t.b", "t.before")

    part = F.col("k")
    high = F.floor(F.col("bin") / _BINS).cast("int")
    bins = rows.groupBy("source", high.alias("b")).agg(F.sum("size").alias("s"))
    first = stage(border(bins, budgets.select("src", "rest", F.lit(0).cast("long").alias("spent"))), "border")
    inner = _at_source(rows, F.col("source"), part, first, "inner").where(high == F.col("b")).groupBy("source", F.pmod("bin", F.lit(_BINS)).alias("b")).agg(F.sum("size").alias("s"))
    known = budgets.select("src", "rest").join(first.select(F.col("src").alias("src2"), F.col("before").alias("spent")), F.col("src").eqNullSafe(F.col("src2"))).drop("src2")
    second = stage(border(inner, known).withColumnRenamed("src", "src3"), "border")
    edge = first.select("src", F.col("b").alias("hi")).join(second, F.col("src").eqNullSafe(F.col("src3")))
    edge = stage(edge.join(budgets.select(F.col("src").alias("src2"), "rest"), F.col("src").eqNullSafe(F.col("src2"))).select("src", "rest", (F.col("hi") * _BINS + F.col("b")).cast("int").alias("edge"), F.col("before").alias("spent")), "edge")

    last = _at_source(rows, F.col("source"), part, edge, "inner").where("bin = edge")
    last = last.groupBy("src", "rest", "spent", "key", "doc_id", "size", "k").agg(F.sum("size").alias("all"))
    run = Window.partitionBy("src").orderBy("key", "doc_id", "size", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("end", F.sum("all").over(run) + F.col("spent"))
    last = last.where(F.col("end") - F.col("rest") <= F.col("rest") - (F.col("end") - F.col("all")))
    # the border bin may give none: then all bins before it are taken, and the cut stands at its upper end
    taken = last.groupBy("src").agg(F.max(F.struct("key", "doc_id", "size", "k")).alias("cut"))
    cut = edge.select("src", "edge").join(taken.withColumnRenamed("src", "src2"), F.col("src").eqNullSafe(F.col("src2")), "left").drop("src2").withColumnRenamed("src", "src2")
    return budgets.join(cut, F.col("src").eqNullSafe(F.col("src2")), "left").select("src", "source_size", "target", "times", "edge", "cut")


def _taken(size: Column, key: Column, doc_id: Column, k: Column) -> Column:
    """How often the cut's source takes a document."""
    at = _bin(key)
    own = F.struct(key.alias("key"), doc_id.alias("doc_id"), size.alias("size"), k.alias("k"))
    more = F.when(F.col("edge").isNull(), False).when(at != F.col("edge"), at < F.col("edge")).otherwise(F.coalesce(own <= F.col("cut"), F.lit(False)))
    return F.col("times") + more.cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, k, source, size, source_size, target, taken) for every document: taken / size is how often it is in the mix."""
    with scratch(docs.sparkSession):
        slim = kept(stage(_facts(docs, id_col, text_col, source_col, quality_col, seed), "sizes"))
        cuts = kept(stage(_cuts(slim, weights, epochs), "cuts"))
    met = _at_source(slim, F.col("source"), F.col("k"), cuts)
    times = _taken(F.col("size"), F.col("key"), F.col("doc_id"), F.col("k"))
    return met.select("doc_id", "k", "source", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: every document with all its columns, as often as the mix takes it; texts of no word aren't taken."""
    with scratch(docs.sparkSession):
        slim = stage(_facts(docs, id_col, text_col, source_col, quality_col, seed), "sizes")
        cuts = kept(stage(_cuts(slim, weights, epochs).select(*[F.col(c).alias(c) for c in ("src", "times", "edge", "cut")]), "cuts"))
    own = _facts(docs, id_col, text_col, source_col, quality_col, seed, F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    met = _at_source(own, F.col("source"), F.col("k"), cuts)
    times = F.when(F.col("size") > 0, _taken(F.col("size"), F.col("key"), F.col("doc_id"), F.col("k"))).otherwise(0).cast("int")
    return met.select("_doc", F.explode(F.array_repeat(F.lit(1), times)).alias("_copy")).select("_doc.*")


SQL = r"""
WITH base AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(length(coalesce(text, '')) AS DOUBLE) AS chars FROM documents),
keyed AS (
  SELECT *, CASE WHEN chars > 0 THEN chars / (chars + least(chars, abs(chars - size * 7.0::DOUBLE))) ELSE 0.5::DOUBLE END AS q,
    (CAST(CAST('0x' || substr(md5('mix-1:' || doc_id), 1, 12) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM base),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM sizes),
filled AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - (sum(3 * source_size) OVER f - 3 * source_size) AS remaining,
    sum(w) OVER () - (sum(w) OVER f - w) AS wide, row_number() OVER f AS rn
  FROM ranked WINDOW f AS (ORDER BY 3 * source_size / w, source NULLS LAST)),
level AS (SELECT min(rn) AS at FROM filled WHERE cap * wide > remaining * w),
targets AS (
  SELECT f.source, f.source_size, CASE WHEN f.rn < coalesce(l.at, 1 << 30) THEN CAST(f.cap AS DOUBLE)
    ELSE CAST(g.remaining * f.w AS DOUBLE) / CAST(g.wide AS DOUBLE) END AS target
  FROM filled f, level l LEFT JOIN filled g ON g.rn = l.at),
placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS times,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY pow(k.u, 1.0 / k.q) DESC, k.doc_id ROWS UNBOUNDED PRECEDING) AS ends
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((times + CASE WHEN ends - size < target - times * source_size
    AND ends - (target - times * source_size) <= (target - times * source_size) - (ends - size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM placed
"""
