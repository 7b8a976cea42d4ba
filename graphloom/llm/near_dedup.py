"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact confirmation on full sets.

1. Every text gives its set of distinct word shingles, from which come a 128-bit digest (BLAKE2) of the whole set and a
   signature of 48 symbols of 16 bits (b-bit MinHash). Rows with one digest and set size are one class; each row of a
   class is held against the class's first on the full sets, and one that differs would get a class of its own. Only
   classes go on, so copies are never paired with each other.
2. Multi-index: the signature is 12 chunks of 4 symbols. Two signatures that differ in at most 23 symbols have a chunk
   with at most one differing symbol (pigeonhole: 12 * 2 = 24), so both hold the same chunk with that symbol masked.
   Enumerating the four masks of each chunk gives 48 keys, and equal keys retrieve every pair within 23.
   A pair at similarity 0.85 is beyond 23 with a probability near 1e-8, at 0.8 near 3e-6.
3. Links are confirmed by exact intersection of the full sets. Buckets of at most SMALL classes give all their pairs,
   which the signature distance filters and the full sets confirm. Larger ones give a star first: each class's nearest
   among its buckets' least classes. Links are contracted; of the large buckets that still have several components, a
   star between components follows, about the class with most links, and the last round orders the shingles of their
   classes by how few classes hold them. Two sets
   that are similar enough share one of their rarest shingles (prefix and position bounds). An outside class meets a
   whole star by what its centre holds, and is held against the centre; only members that the two intersections with
   the centre don't rule out are paired with it. Shingles that a member holds besides its centre pair it directly. All
   pairs pass the signature distance and the full sets. Copies that each have their own changes share none, and make
   no pair. No link between components is lost.

Defined results: null or empty texts have an empty set, their own component and are kept; a text with fewer words than
a shingle has one shingle; repeated rows share a component; a null doc_id counts as larger than any other, and a
component of only such rows is null. Columns of the input other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import bounded_broadcast, kept, row_key, scratch, slices, stage, text_bytes, trimmed, unstage
from .components import components

CHUNKS, SYMBOLS = 12, 4
#: Largest signature distance that the index guarantees to find.
RADIUS = 2 * CHUNKS - 1
#: Classes of a bucket whose pairs are all tried; larger buckets take the stars and the rarest shingles.
SMALL = 16
#: Members of a star that an outside class is tried with before all that it may be similar to.
FIRST = 16
_SEEDS = tokens.mix(np.arange(1, CHUNKS * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_FACTORS = tokens.mix(_SEEDS) | np.uint64(1)
SIG = [f"s{c}" for c in range(CHUNKS)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _per_text(values: np.ndarray, offsets: np.ndarray, how: np.ufunc) -> np.ndarray:
    """how.reduce over each text's values; 0 for texts without any."""
    full = np.diff(offsets) > 0
    out = np.zeros(len(full), values.dtype)
    if full.any():
        out[full] = how.reduceat(values, offsets[:-1][full])
    return out


def signatures(size: int, digest_bytes: int):
    """mapInArrow function: (doc_id, k, text, t) to (doc_id, k, t, n, f, s0 ..); f: digest of the sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column(2))
            hashes, text, _, _ = tokens.words(raw, offsets)
            values, ends = tokens.shingles(hashes, text, batch.num_rows, size)
            data = memoryview(values.tobytes())
            digests = [hashlib.blake2b(data[8 * i : 8 * j], digest_size=digest_bytes).digest() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            cols = [pa.array(_signed(np.diff(ends))), pa.array(digests, pa.binary())]
            for c in range(CHUNKS):
                packed = np.zeros(batch.num_rows, np.uint64)
                for s in range(SYMBOLS):
                    k = c * SYMBOLS + s
                    least = _per_text((values ^ _SEEDS[k]) * _FACTORS[k], ends, np.minimum)
                    packed |= (tokens.mix(least) >> np.uint64(48)) << np.uint64(16 * s)
                cols.append(pa.array(_signed(packed)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *cols], names=["doc_id", "k", "t", "n", "f", *SIG])

    return run


def full_sets(size: int):
    """mapInArrow function: (k, node, text) to (k, node, items): the whole sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column(2))
            hashes, text, _, _ = tokens.words(raw, offsets)
            values, ends = tokens.shingles(hashes, text, batch.num_rows, size)
            items = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_signed(values)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), items], names=["k", "node", "items"])

    return run


def _distance(a: str, b: str):
    """Symbols in which two signatures differ: 16-bit lanes of the xor that aren't 0."""
    total = None
    for s in SIG:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        one = F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
        total = one if total is None else total + one
    return total


def _near(a: str, b: str, percent: int):
    """The two may reach the similarity: by set sizes, and by signature distance."""
    sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    return sizes & (_distance(a, b) <= RADIUS)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    left, right = (sets.select(F.col("node").alias(x), F.col("items").alias(f"{x}_items")) for x in "ab")
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    shared = F.size(F.array_intersect("a_items", "b_items"))
    met = both.select("a", "b", shared.alias("i"), (F.size("a_items") + F.size("b_items")).alias("t"))
    return met.where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * percent).select("a", "b")


def _stars(left: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp, g, c): each of the classes left (node, comp) with the centre of its star, and the star's size.

    A class's centre is the one linked with it that has most links, if that isn't another's centre itself."""
    ends = links.union(links.select("b", "a")).toDF("node", "g")
    many = ends.groupBy("g").agg(F.count("*").alias("many"))
    best = ends.join(left.select("node"), "node").join(many, "g").groupBy("node").agg(F.max(F.struct("many", "g")).alias("t")).select("node", "t.g")
    best = stage(best, "centres")
    own = best.select(F.col("g").alias("node"), F.lit(True).alias("centre")).distinct()
    dealt = left.join(best, "node", "left").join(own, "node", "left").select("node", "comp", F.when(F.col("centre"), F.col("node")).otherwise(F.coalesce("g", "node")).alias("g"))
    dealt = stage(dealt, "left")
    return dealt.join(dealt.groupBy("g").agg(F.count("*").alias("c")), "g").select("node", "comp", "g", "c")


def _ranked(sets: DataFrame, stars: DataFrame) -> DataFrame:
    """(item, node, n, i, comp, g, c, core): the shingles of the classes in stars that other sets hold too.

    Shingles are in one order, those that fewer of the sets hold first; i is the place in the set. core: the centre of
    the class's star holds the shingle as well (a class without a star is its own centre)."""
    items = sets.select("node", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = stage(items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1"), "often")
    each = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(each) + F.row_number().over(each.orderBy("df", "item"))
    placed = items.join(often, "item").join(stars, "node").select("item", "node", "n", place.cast("int").alias("i"), "comp", "g", "c")
    centres = stars.where("g != node").select(F.col("g").alias("node")).distinct()
    held = sets.join(centres, "node").select(F.col("node").alias("g"), F.explode("items").alias("item"), F.lit(True).alias("held"))
    rows = placed.join(held, ["g", "item"], "left")
    ranked = stage(rows.select("item", "node", "n", "i", "comp", "g", "c", (F.col("held").isNotNull() | (F.col("g") == F.col("node"))).alias("core")), "ranked")
    unstage(often)
    return ranked


def _rare_pairs(rows: DataFrame, sets: DataFrame, percent: int, first: int | None = None) -> DataFrame:
    """(a, b) of different components that may reach the similarity: every pair that does is there.

    first: instead, of what meets a star, the pairs with so many of its members alone, those nearest to its centre.

    Two such sets have an intersection of at least percent * (n_a + n_b) / (100 + percent), so their first common
    shingle is among the first n - ceil(n * percent / 100) + 1 of each, and what follows its places bounds the
    intersection. Let a belong to the smaller star. If that shingle isn't in the centre of b's star, the two meet by it.
    If it is, a meets the star, once for all its members, and is held against the centre: the intersection with b is at
    most what both have in common with the centre, and what b holds besides that any other set holds too. Only members
    for which that suffices are paired."""
    prefix = rows.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    x = prefix.select("item", *(F.col(c).alias(f"x{c}") for c in ("node", "n", "i", "comp", "g", "c")))
    other = (F.col("xcomp") != F.col("comp")) & ((F.col("xc") < F.col("c")) | ((F.col("xc") == F.col("c")) & (F.col("xg") < F.col("g"))))

    def enough(shared, n):
        return shared * (100 + percent) >= (F.col("xn") + n) * percent

    pair = [F.col("xnode").alias("a"), F.col("node").alias("b")]
    left = F.least(F.col("xn") - F.col("xi"), F.col("n") - F.col("i")) + 1
    beside = x.join(prefix.where("not core"), "item").where(other & enough(left, F.col("n"))).select(*pair).distinct()

    stars = prefix.where("core").groupBy("item", "comp", "g", "c").agg(F.min("n").alias("least"), F.max(F.col("n") - F.col("i")).alias("after"))
    left = F.least(F.col("xn") - F.col("xi"), F.col("after")) + 1
    met = stage(x.join(stars, "item").where(other & enough(left, F.col("least"))).select("xnode", "xn", "xcomp", "g", "comp").distinct(), "met")
    own, centre = (sets.select(F.col("node").alias(k), F.col("items").alias(f"{k}_items")) for k in ("xnode", "g"))
    shared = F.size(F.array_intersect("xnode_items", "g_items")).alias("xin")
    held = met.join(own, "xnode").join(centre, "g").select("xnode", "xn", "xcomp", "g", "comp", shared)
    inside = F.when(F.col("g") == F.col("node"), F.col("n")).otherwise(F.count_if("core"))
    members = rows.groupBy("g", "node", "n").agg(inside.cast("int").alias("in"), F.count_if(~F.col("core")).cast("int").alias("out"))
    if first is not None:
        nearest = F.row_number().over(Window.partitionBy("g").orderBy(F.col("out"), F.desc("in"), "node"))
        members = members.withColumn("_at", nearest).where(F.col("_at") <= first).drop("_at")
    most = F.least("xin", "in") + F.least(F.col("out"), F.col("xn") - F.col("xin"))
    through = held.join(members, "g").where(enough(most, F.col("n"))).select(*pair)
    return through.distinct() if first is not None else beside.union(through).distinct()


def _texts_sets(base: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(k, node, items) of the wanted (k, node)."""
    texts = base.join(bounded_broadcast(wanted), "k").select("k", "node", "text")
    return texts.mapInArrow(trimmed(full_sets(size)), "k binary, node bigint, items array<bigint>")


def _classes(base: DataFrame, size: int, digest_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without words; rows (doc_id, k, n, node); classes (node, k, n, s0 ..), whose rows have equal sets."""
    kinds = ", ".join(["doc_id bigint", "k binary", "t binary", "n bigint", "f binary", *(f"{s} bigint" for s in SIG)])
    rows = stage(base.mapInArrow(trimmed(signatures(size, digest_bytes)), kinds), "signatures")
    one = F.min(F.struct("k", "t", *SIG)).alias("one")
    classes = rows.where("n > 0").groupBy("f", "n").agg(one, F.count("*").alias("c"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("node"), "f", "n", "c", "one.*"), "classes")
    named = rows.where("n > 0").select("doc_id", "k", "t", "n", "f").join(classes.select("f", "n", "node", "c", F.col("t").alias("head")), ["f", "n"])
    placed = stage(named.select("doc_id", "k", "t", "n", "node", "c", "head"), "placed")
    empty = stage(rows.where("n = 0").select("doc_id", "k", "n"), "empty")

    # copies of one text share its set: a class's other texts are held against its first, each once
    others = stage(placed.where("c > 1 and t != head").groupBy("t", "node").agg(F.min("k").alias("k")), "others")
    if others.take(1):
        several = classes.join(bounded_broadcast(stage(others.select("node").distinct(), "several")), "node", "left_semi")
        heads = _texts_sets(base, stage(several.select("k", "node"), "heads"), size).dropDuplicates(["node"])
        heads = stage(heads.select("node", F.col("items").alias("ours")), "sets")
        differ = _texts_sets(base, others.select("k", "node"), size).join(bounded_broadcast(heads), "node").where("items != ours")
        differ = stage(differ.select("k", "node", "items").dropDuplicates(["k"]).join(others.select("k", "t"), "k"), "differ")
        if differ.take(1):  # two sets of one digest: classes of their own, by the sets themselves
            apart = differ.groupBy("node", "items").agg(F.min("k").alias("head"))
            apart = stage(apart.select((-1 - F.monotonically_increasing_id()).alias("own"), "node", "items", "head"), "apart")
            moved = stage(differ.join(apart, ["node", "items"]).select("t", "own"), "moved")
            more = apart.join(rows.dropDuplicates(["k"]), F.col("head") == F.col("k")).select(F.col("own").alias("node"), "f", "n", F.lit(1).cast("long").alias("c"), "k", "t", *SIG)
            classes = stage(classes.union(more), "classes")
            placed = placed.join(moved, "t", "left").withColumn("node", F.coalesce("own", "node"))
    placed = stage(placed.select("doc_id", "k", "n", "node"), "placed")
    unstage(rows)
    return empty, placed, classes


def link_classes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, digest_bytes: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(empty, rows, labels): rows without words, a row (doc_id, k, n, node) for each other, (node, component) of links."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"), row_key(text_col).alias("t"))
    empty, rows, classes = _classes(base, size, digest_bytes)

    masks = [~0xFFFF, ~(0xFFFF << 16), ~(0xFFFF << 32), (1 << 48) - 1]
    keys = [F.xxhash64(F.lit(c * SYMBOLS + i), F.col(SIG[c]).bitwiseAND(F.lit(m))) for c in range(CHUNKS) for i, m in enumerate(masks)]
    index = classes.select("node", F.explode(F.array(*keys)).alias("key"))
    shared = stage(index.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("b")).where("c > 1"), "buckets")
    members = stage(index.join(shared, "key").select("key", "node", "b", "c"), "members")

    full = classes.select("node", F.struct("n", *SIG).alias("sig"))
    sa, sb = full.select(F.col("node").alias("a"), F.col("sig").alias("x")), full.select(F.col("node").alias("b"), F.col("sig").alias("y"))

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ..) that may reach the similarity, with their distance d."""
        return pairs.join(sa, "a").join(sb, "b").where(_near("x", "y", percent)).withColumn("d", _distance("x", "y")).drop("x", "y")

    few = members.where(F.col("c") <= SMALL).select("key", "node")
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b").distinct()
    spokes = near(members.where((F.col("c") > SMALL) & (F.col("node") != F.col("b"))).select(F.col("node").alias("a"), "b").distinct())
    spokes = spokes.groupBy("a").agg(F.min(F.struct("d", "b")).alias("t")).select("a", "t.b")
    tried = stage(near(pairs).select("a", "b").union(spokes).distinct(), "pairs")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Whole sets of these classes, each from one document."""
        wanted = stage(nodes.distinct().join(classes.select("node", "k"), "node").select("k", "node"), "wanted")
        return stage(_texts_sets(base, wanted, size).select("node", "items").dropDuplicates(["node"]), "sets")

    sets = sets_of(tried.select(F.explode(F.array("a", "b")).alias("node")))
    links = stage(_confirmed(tried, sets, percent), "links")
    labels = stage(components(links, "a", "b"), "labels")

    def contract(pairs: DataFrame, sets: DataFrame) -> None:
        """Confirm the pairs and contract their links."""
        nonlocal links, labels
        links = links.union(stage(_confirmed(pairs, sets, percent), "links"))
        labels = stage(components(links, "a", "b"), "labels")

    def still_open() -> tuple[DataFrame, DataFrame]:
        """Members of the large buckets with their components, and those of these buckets that have several."""
        many = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("many"))
        at = members.where(F.col("c") > SMALL).join(labels, "node", "left").join(many, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"), F.coalesce("many", F.lit(0)).alias("many"))
        several = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("many", "comp", "node")).alias("most")).where("lo != hi")
        return at, stage(several.select("key", F.col("most.node").alias("b"), F.col("most.comp").alias("cb")), "open")

    # large buckets: a star between components, about the class with most links: the nearest members of each two
    at, open_ = still_open()
    if not open_.take(1):
        return empty, rows, labels
    spokes = at.select("key", F.col("node").alias("a"), F.col("comp").alias("ca")).join(open_, "key").where("ca != cb").select("a", "ca", "b", "cb").distinct()
    found = stage(near(spokes).groupBy("ca", "cb").agg(F.min(F.struct("d", "a", "b")).alias("t")).select("t.a", "t.b"), "cross")
    if found.take(1):
        contract(found, sets_of(found.select(F.explode(F.array("a", "b")).alias("node"))))
        at, open_ = still_open()
        if not open_.take(1):
            return empty, rows, labels

    # what is left in them: the pairs that share one of their rarest shingles
    left = at.join(open_.select("key"), "key").select("node", "comp").distinct()
    stars = stage(_stars(left, links), "stars")
    sets = sets_of(stars.select(F.explode(F.array("node", "g")).alias("node")))
    ranked = _ranked(sets, stars)
    # a class that links with one of a star's members is done with it: the nearest members first, then all for the rest
    found = stage(near(_rare_pairs(ranked, sets, percent, FIRST)).select("a", "b"), "cross")
    if found.take(1):
        contract(found, sets)
        ranked = ranked.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    found = stage(near(_rare_pairs(ranked, sets, percent)).select("a", "b"), "cross")
    if found.take(1):
        contract(found, sets)
    return empty, rows, labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, digest_bytes: int = 16) -> DataFrame:
    """(doc_id, k, n_shingles, component_id, kept): every document with the smallest doc_id that links reach.

    size: words of a shingle. percent: least similarity (Jaccard), in hundredths. k: row_key(id, text). The result is
    staged; all that was staged for it is deleted."""
    with scratch(docs.sparkSession):
        empty, rows, labels = link_classes(docs, id_col, text_col, size, percent, digest_bytes)
        placed = rows.join(labels, "node", "left").select("doc_id", "k", "n", F.coalesce("component", "node").alias("comp"))
        heads = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")).where("c > 1")
        heads = stage(heads.select("comp", "component_id"), "heads")
        grouped = placed.join(heads, "comp", "left").select("doc_id", "k", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        out = grouped.union(empty.select("doc_id", "k", "n", "doc_id"))
        return kept(stage(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "groups"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents less all but the first (smallest id) of each group, with all their columns.

    Rows of equal id and text count once: the one that is least, as JSON, in its other columns."""
    with scratch(docs.sparkSession):
        found = near_duplicates(docs, id_col, text_col, size, percent).select("k", "kept")
        keys = found.groupBy("k").agg(F.min("kept").alias("kept"), F.count("*").alias("c"))
        marks = kept(stage(keys.where("not kept or c > 1").select(F.col("k").alias("_mark"), F.col("kept").alias("_first")), "marks"))
    own = row_key(id_col, text_col)
    side = marks.select("_mark")
    out = docs.join(bounded_broadcast(side), own == side["_mark"], "left_anti")
    again = marks.where("_first").select("_mark")
    if not again.take(1):
        return out
    whole = F.struct(*[docs[c] for c in docs.columns])
    once = docs.join(bounded_broadcast(again), own == again["_mark"]).groupBy(again["_mark"].alias("_mark")).agg(F.min_by(whole, F.to_json(whole)).alias("_one"))
    return out.union(once.select("_one.*"))
