"""Importance resampling to a target distribution, over bucket-partitioned inverted postings.

A text's features are its words (runs of digits, a-z and bytes from 0x80 on, with A-Z in lower case) and its pairs of
consecutive words; a feature's bucket is its crc32 modulo `buckets`. A bucket's gain is the log ratio of its smoothed
shares in the target and in the corpus, in thousandths; a document's weight is the floored mean of its features' gains.
Gumbel keys on the weights draw a share of the documents without replacement.

1. Postings. Texts are cut into slices of bounded bytes. A slice gives one row for each of RANGES ranges of buckets: its
   (bucket, document, count) postings in bucket order, as compact arrays. They are staged once.
2. Counts of a bucket are added up within each task before they are shuffled: `buckets` rows a task at most.
3. Postings go by shuffle to (range, group of at most GROUP slices): a bucket that every document holds is so split into
   parts of bounded size. There they meet both corpora's counts of the range; gains are computed there, and what goes on
   is one number for each document of a slice and range, its part of the document's sum.
4. Parts are added up by slice, where the documents' ids and sizes join them.
5. The order of the draw is one range-partitioned sort; rows are numbered within a range, ranges offset by those before.

Defined results: null texts are empty; texts without a word have no feature and weight 0; repeated rows are documents of
their own, which share weight, key and score (so their order among each other is free); a null doc_id's key is that of
an empty id, and it comes last of equal scores; an empty target gives gains of an empty one (t and T are 0); an empty
table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, row_key, scratch, slices, stage, text_bytes, trimmed

#: Ranges into which buckets are dealt, and slices of a group: what one shuffled group holds.
RANGES, GROUP = 16, 64
#: Bytes of a text that are cut into words at a time.
_PART = 2 << 20
#: Words longer than this are hashed one by one.
_LONG = 48
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _spelled(state: np.ndarray, raw: np.ndarray, start: np.ndarray, length: np.ndarray, order: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each word. order: words by falling length; counts[k]: words longer than k bytes."""
    out = state[order]
    at, long = start[order], int(counts[_LONG]) if len(counts) > _LONG else 0
    for k in range(min(len(counts), _LONG)):
        n = counts[k]
        if n == long:
            break
        own = out[long:n]
        out[long:n] = _CRC[(own ^ raw[at[long:n] + k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    for i in range(long):
        word = order[i]
        out[i] = zlib.crc32(raw[start[word] : start[word] + length[word]].tobytes(), int(out[i] ^ _ONES)) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and text number of every word of lower-cased bytes."""
    inside = _WORD[raw]
    before = np.empty(len(raw), bool)
    before[:1], before[1:] = False, inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    joined = inside.copy()  # where a word goes on from the byte before
    joined &= before
    joined[firsts] = False
    start = np.flatnonzero(inside & ~joined)
    stop = np.empty(len(raw), bool)
    stop[:-1], stop[-1:] = ~joined[1:], True
    end = np.flatnonzero(inside & stop) + 1
    return start, end - start, np.searchsorted(offsets[1:], start, side="right")


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text number, bucket) of all features of texts given by their bytes, words before pairs; each text's words; where
    the last word begins."""
    raw = _LOWER[raw]
    start, length, text = _words(raw, offsets)
    order = np.argsort(-np.minimum(length, _LONG + 1).astype(np.int16), kind="stable")
    counts = len(length) - np.cumsum(np.bincount(np.minimum(length, _LONG + 1), minlength=1))[:-1]
    state = _spelled(np.full(len(start), _ONES), raw, start, length, order, counts)
    second = np.flatnonzero(text[1:] == text[:-1]) + 1
    spaced = np.full(len(start), _ONES)
    own = state[second - 1]
    spaced[second] = _CRC[(own ^ np.uint32(32)) & np.uint32(255)] ^ (own >> np.uint32(8))
    pairs = _spelled(spaced, raw, start, length, order, counts)[second]
    found = (np.concatenate([state, pairs]) ^ _ONES) % np.uint32(buckets)
    return np.concatenate([text, text[second]]), found.astype(np.int64), np.bincount(text, minlength=len(offsets) - 1), int(start[-1]) if len(start) else -1


def _long_text(raw: np.ndarray, buckets: int) -> tuple[np.ndarray, int]:
    """Counts by bucket and words of one text, part by part: each part begins with the last word of the one before."""
    total, words, carried, begin, done = np.zeros(buckets, np.int64), 0, False, 0, 0
    inside = _WORD[_LOWER[raw]]
    while done < len(raw):
        end = min(len(raw), done + _PART)
        while end < len(raw) and inside[end] and inside[end - 1]:
            gap = np.flatnonzero(~inside[end : end + _PART])
            end = end + int(gap[0]) if len(gap) else min(len(raw), end + _PART)
        _, bucket, counted, last = features(raw[begin:end], np.array([0, end - begin]), buckets)
        total += np.bincount(bucket, minlength=buckets)
        words += int(counted[0])
        if carried:  # its first word was counted before
            total[bucket[0]] -= 1
            words -= 1
        carried = last >= 0
        begin, done = begin + last if carried else end, end
    return total, words


def _least(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, as bytes of the narrowest type that holds them all."""
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n]).astype(np.int64) if n else np.zeros(0, np.int64)


_BLOCKS = "range int, grp bigint, slice bigint, sizes binary, docs binary, counts binary, ids array<bigint>, keys array<binary>, words array<bigint>"


def _inverted(buckets: int, width: int):
    """mapInArrow function: (doc_id, k, text) to the blocks of every slice; range -1 holds the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text")):
            raw, offsets = text_bytes(batch.column(2))
            rows = batch.num_rows
            if rows == 1 and len(raw) > 2 * _PART:
                counts, n = _long_text(raw, buckets)
                words, bucket = np.array([n]), np.flatnonzero(counts)
                counts, doc = counts[bucket], np.zeros(len(bucket), np.int64)
            else:
                text, bucket, words, _ = features(raw, offsets, buckets)
                keys = np.sort(bucket * rows + text)
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                counts = np.diff(np.concatenate([first, [len(keys)]]))
                bucket, doc = np.divmod(keys[first], rows)
            cuts = np.searchsorted(bucket, np.arange(RANGES + 1) * width)
            parts = [(r, slice(a, b)) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            n = len(parts) + 1
            group, own = (task << 24) + number // GROUP, (task << 24) + number
            sizes = [_least(np.bincount(bucket[at] - r * width, minlength=width)) for r, at in parts]
            columns = [
                pa.array([-1, *(r for r, _ in parts)], pa.int32()),
                pa.array([group] * n, pa.int64()),
                pa.array([own] * n, pa.int64()),
                pa.array([None, *sizes], pa.binary()),
                pa.array([None, *(_least(doc[at]) for _, at in parts)], pa.binary()),
                pa.array([None, *(_least(counts[at]) for _, at in parts)], pa.binary()),
                pa.array([batch.column(0).to_pylist()] + [None] * (n - 1), pa.list_(pa.int64())),
                pa.array([batch.column(1).to_pylist()] + [None] * (n - 1), pa.list_(pa.binary())),
                pa.array([words.tolist()] + [None] * (n - 1), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["range", "grp", "slice", "sizes", "docs", "counts", "ids", "keys", "words"])

    return run


def _block(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the bucket in its range, document, count) of a block's postings."""
    sizes = _wide(row["sizes"], width)
    n = int(sizes.sum())
    return np.repeat(np.arange(width), sizes), _wide(row["docs"], n), _wide(row["counts"], n)


def _rows_of(counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["bucket", "c"])


def _block_counts(buckets: int, width: int):
    """mapInArrow function: blocks to (bucket, count), added up over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RANGES * width, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                place, _, counts = _block(row, width)
                total[row["range"] * width : (row["range"] + 1) * width] += np.bincount(place, counts, width).astype(np.int64)
        yield _rows_of(total[:buckets])

    return run


def _text_counts(buckets: int):
    """mapInArrow function: (text) to (bucket, count), added up over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column(0))
            if batch.num_rows == 1 and len(raw) > 2 * _PART:
                total += _long_text(raw, buckets)[0]
            else:
                total += np.bincount(features(raw, offsets, buckets)[1], minlength=buckets)
        yield _rows_of(total)

    return run


def _gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    ratio = (float(t + 1) * float(all_s + buckets)) / (float(s + 1) * float(all_t + buckets))
    return math.floor(1000.0 * math.log(ratio))


def _parts(buckets: int, width: int, all_s: int, all_t: int):
    """Cogrouped by (range, grp): blocks and the range's counts in both corpora, to (slice, sums of the documents)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        gains = np.zeros(width, np.int64)
        for c in right.column("both")[0].as_py() if right.num_rows else ():
            gains[c["bucket"] % width] = _gain(c["s"], c["t"], all_s, all_t, buckets)
        slices_of, sums = [], []
        for row in left.to_pylist():
            place, doc, counts = _block(row, width)
            slices_of.append(row["slice"])
            sums.append(np.bincount(doc, (counts * gains[place]).astype(float)).astype(np.int64).tolist())  # exact below 2**53
        return pa.table({"slice": pa.array(slices_of, pa.int64()), "sums": pa.array(sums, pa.list_(pa.int64()))})

    return run


def _weights(left: pa.Table, right: pa.Table) -> pa.Table:
    """Cogrouped by slice: sums of the ranges, and the slice's documents, to a row for each document."""
    docs = [row for row in right.to_pylist()]
    ids, keys, words = ([v for row in docs for v in row[c]] for c in ("ids", "keys", "words"))
    total = np.zeros(len(ids), np.int64)
    for sums in left.column("sums").to_pylist():
        total[: len(sums)] += np.array(sums, np.int64)
    n_words = np.array(words, np.int64)
    n = np.maximum(2 * n_words - 1, 0)
    weight = total // np.maximum(n, 1)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "k": pa.array(keys, pa.binary()), "n_words": pa.array(n_words), "n_features": pa.array(n), "weight": pa.array(weight)})


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", buckets: int = 10_000) -> DataFrame:
    """(doc_id, k, n_words, n_features, weight) for every document; k is a hash of its id and text. Not staged."""
    width = -(-buckets // RANGES)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    blocks = stage(base.mapInArrow(trimmed(_inverted(buckets, width)), _BLOCKS), "postings")
    postings = blocks.where("range >= 0").select("range", "grp", "slice", "sizes", "docs", "counts")
    own = postings.select("range", "sizes", "docs", "counts").mapInArrow(trimmed(_block_counts(buckets, width)), "bucket int, c bigint")
    wanted = target.select(F.col(target_text).cast("string").alias("text")).mapInArrow(trimmed(_text_counts(buckets)), "bucket int, c bigint")
    added = lambda rows, name: rows.groupBy("bucket").agg(F.sum("c").alias(name))
    both = stage(added(own, "s").join(added(wanted, "t"), "bucket", "full").select("bucket", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("s", "t")]), "counts")
    all_s, all_t = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    ranges = both.groupBy(F.floor(F.col("bucket") / width).cast("int").alias("range")).agg(F.collect_list(F.struct("bucket", "s", "t")).alias("both"))
    met = postings.select("range", "grp").distinct().join(F.broadcast(ranges), "range")  # RANGES rows of `width` buckets
    met = met.select(F.col("range").alias("own_range"), F.col("grp").alias("own_grp"), "both")
    parts = postings.groupBy("range", "grp").cogroup(met.groupBy("own_range", "own_grp")).applyInArrow(_parts(buckets, width, all_s, all_t), "slice bigint, sums array<bigint>")
    named = blocks.where("range < 0").select(F.col("slice").alias("own_slice"), "ids", "keys", "words")
    return parts.groupBy("slice").cogroup(named.groupBy("own_slice")).applyInArrow(_weights, "doc_id bigint, k binary, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id, seed: str):
    """floor(-1000 * ln(-ln(u))), u from the first 8 hex digits of sha256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = 25, least_words: int = 20, seed: str = "7", buckets: int = 10_000) -> DataFrame:
    """(doc_id, k, n_words, n_features, weight, score, rank) for every document; rank is null for those not drawn."""
    with scratch(docs.sparkSession):
        weighed = weigh(docs, target, id_col, text_col, target_text, buckets)
        scored = stage(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
        able = scored.where(F.col("n_words") >= least_words)
        take = percent * able.count() // 100
        # equal rows may be split between ranges: a third key tells them apart
        ranged = able.withColumn("_tie", F.monotonically_increasing_id()).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "_tie")
        ranged = stage(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "drawn")
        part = F.shiftright("_at", 33)
        many = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a range
        before = many.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
        met = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
        place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        columns = ["doc_id", "k", "n_words", "n_features", "weight", "score"]
        ranked = met.select(*columns, F.when(place <= take, place).cast("long").alias("rank"))
        rest = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
        return kept(stage(ranked.unionByName(rest), "resampled"))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are drawn, with all their columns. Of equal rows at the border so many as are drawn."""
    got = resample(docs, target, id_col, text_col, **options)
    with scratch(docs.sparkSession):
        per = got.groupBy("k").agg(F.count("rank").alias("n"), F.count("*").alias("all")).where("n > 0")
        per = kept(stage(per, "keys"))
    # rows of equal k stand together in the order, so at most one k is drawn in part
    own, border = row_key(id_col, text_col), per.where("n < all").first()
    whole = per.where("n = all").select(F.col("k").alias("_drawn"))
    out = docs.join(whole, own == whole["_drawn"], "left_semi")
    return out if border is None else out.union(docs.where(own == F.lit(border["k"])).limit(border["n"]))


#: DuckDB SQL of the query. crc32 has no function there: it is folded byte by byte over the distinct features.
SQL = r"""
WITH RECURSIVE texts AS MATERIALIZED (
  SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
numbered AS MATERIALIZED (
  SELECT own, doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
feature AS MATERIALIZED (
  SELECT own, n, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM numbered),
bits(b, c, k) AS (
  SELECT b, b, 0 FROM range(256) AS r(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc_table AS MATERIALIZED (SELECT b, c FROM bits WHERE k = 8),
kinds AS MATERIALIZED (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM feature)),
folded(f, x, pos, crc) AS (
  SELECT f, x, 0, 4294967295::BIGINT FROM kinds
  UNION ALL SELECT f, x, pos + 1, xor(crc // 256, t.c) FROM folded
    JOIN crc_table t ON t.b = xor(crc % 256, CAST('0x' || substr(x, 2 * pos + 1, 2) AS BIGINT)) WHERE 2 * pos < length(x)),
bucket AS MATERIALIZED (SELECT f, xor(crc, 4294967295) % 10000 AS b FROM folded WHERE 2 * pos = length(x)),
met AS MATERIALIZED (SELECT own, n, b FROM feature JOIN bucket USING (f)),
counts AS (SELECT b, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM met GROUP BY b),
sums AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gains AS (SELECT b, CAST(floor(1000.0::DOUBLE * ln(((c.t + 1)::DOUBLE * (sums.s + 10000)::DOUBLE) / ((c.s + 1)::DOUBLE * (sums.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts c, sums),
weights AS (SELECT n, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n_features FROM met JOIN gains USING (b) WHERE own GROUP BY n),
scored AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
    (CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM numbered LEFT JOIN weights USING (n) WHERE own),
keyed AS (SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln(u))) AS BIGINT) AS score, n_words >= 20 AS able FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM keyed)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""
