"""Language-model scores of whole texts: a bigram model in sharded Elias-Fano tries, learned from the corpus.

Tokens are words in lower case and one end a text, which also is the first word's context. The model is
p(w | v) = (c(v, w) + MU * p1(w)) / (c(v) + MU) with p1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)): a probability over the
V known words and one unknown. In the tries log10 p is quantised to 16 bits (steps of 0.00025).

The corpus is read in blocks (some MB of texts), each with a vocabulary of its own, and only two tables are shuffled,
both as packed bytes: each block's distinct words, and its distinct bigrams. A shard of words (by hash) adds up the
counts of all blocks and numbers its words, so that all words of the corpus are numbered without gaps; a shard of
bigrams (by context, hot contexts salted) adds up the counts, builds its trie over the numbers, and answers every
block's lookups by successor search. A hot word or pair is one entry a block, however often it occurs; a block asks only
shards that it has words of; shards and buckets of blocks grow in number with the corpus, so no task holds more than a
share, and the vocabulary is never on the driver.

Order 2: contexts are single words, and what is seen of longer ones isn't used.

Defined results: null and empty texts are one end token; a null id counts as an empty text in the split; repeated
rows count each; an empty table gives an empty one, and without any training row all counts are 0. Two words are told
apart by 64 bits of a hash. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import bounded_broadcast, kept, scratch, slices, stage, stage_by, text_bytes
from .elias_fano import Trie

MU = 100.0
BLOCK_BYTES = 12 << 20
#: Blocks of text that a task holds at once, about.
BUCKET_BLOCKS = 8
#: Tokens for each shard, about.
SHARD_TOKENS = 1_500_000
#: A context is dealt to several shards if its share of the tokens is over 1 / (SPLIT * shards).
SPLIT = 2
_END = np.uint64(0x5DEECE66D5DEECE7)
_BLOCK = "block bigint, ids array<bigint>, held array<boolean>, ends array<bigint>, tokens binary, n_words bigint, words binary, counts binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, compressed; small values cost little."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.stack([((values >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8) for i in range(width)]) if len(values) else np.zeros((1, 0), np.uint8)
    body = pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""
    return bytes([width]) + len(values).to_bytes(7, "little") + body


def unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=width * n, codec="zstd"), np.uint8).reshape(width, n)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out |= planes[i].astype(np.uint64) << np.uint64(8 * i)
    return out


def _u(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64)


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, held, text) to blocks. Words of a block are numbered by frequency."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in slices(batches, "text", BLOCK_BYTES):
        raw, offsets = text_bytes(batch.column(2))
        hashes, text, _, _ = tokens.words(raw, offsets)
        rows = batch.num_rows
        ends = np.cumsum(np.bincount(text, minlength=rows) + 1)  # one end token a text
        every = np.full(int(ends[-1]) if rows else 0, _END)
        where = np.ones(len(every), bool)
        where[ends - 1] = False
        every[where] = hashes
        held = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        kinds, at, often = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.empty(len(kinds), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(kinds))
        trained = np.repeat(~held, np.diff(np.concatenate([[0], ends])))
        counts = np.bincount(at[trained], minlength=len(kinds))
        by_rank = np.argsort(rank)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([pack(_u(rank[at]))], pa.binary()), pa.array([len(kinds)]), pa.array([pack(kinds[by_rank])], pa.binary()), pa.array([pack(_u(counts[by_rank]))], pa.binary())],
            names=["block", "ids", "held", "ends", "tokens", "n_words", "words", "counts"],
        )
        number += 1


def _words_of(words: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes in order, their numbers, training counts in the block)."""
    hashes = unpack(words)
    order = np.argsort(hashes)
    return hashes[order], order, unpack(counts).astype(np.int64)[order]


def word_requests(shards: int):
    """mapInArrow: blocks to (shard, block, data): each shard's range of the block's words, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hashes, _, own = _words_of(words, counts)
                shard = (hashes >> np.uint64(32)).astype(np.int64) * shards >> 32
                asked, first = np.unique(shard, return_index=True)
                ends = np.append(first[1:], len(shard))
                data = [_join([hashes[lo:hi], own[lo:hi]]) for lo, hi in zip(first, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(np.full(len(asked), block)), pa.array(data, pa.binary())], names=["shard", "block", "data"])

    return run


def _split(data: bytes, parts: int) -> list[np.ndarray]:
    out = []
    for _ in range(parts - 1):
        n = int.from_bytes(data[:8], "little")
        out.append(unpack(data[8 : 8 + n]))
        data = data[8 + n :]
    return [*out, unpack(data)]


def _join(arrays: list[np.ndarray]) -> bytes:
    packed = [pack(_u(a)) for a in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in packed[:-1]) + packed[-1]


def count_words(table: pa.Table) -> pa.Table:
    """applyInArrow of a shard: adds the blocks' counts; answers each block with its words' counts in the corpus and
    their numbers within the shard (as steps, for they rise). size, n, v: of the shard, in its first row."""
    blocks = table["block"].to_numpy()
    got = [_split(d, 2) for d in table["data"].to_pylist()]
    kinds, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    total = np.bincount(at, np.concatenate([g[1] for g in got]).astype(float), len(kinds)).astype(np.int64)
    ends = np.cumsum([len(g[0]) for g in got])[:-1]
    answers = [_join([total[part], np.diff(part, prepend=0)]) for part in np.split(at, ends)]
    first = np.arange(len(blocks)) == 0
    return pa.table({"shard": table["shard"], "block": table["block"], "data": pa.array(answers, pa.binary()), "size": pa.array(np.where(first, len(kinds), 0)), "n": pa.array(np.where(first, total.sum(), 0)), "v": pa.array(np.where(first, (total > 0).sum(), 0))})


def _bigrams(ranks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every token's bigram of word numbers, as context << 32 | word."""
    before = np.roll(ranks, 1)
    before[np.concatenate([[0], ends[:-1]])] = ranks[-1]  # the end token stands before a text's first
    pairs = (before << 32) | ranks
    return np.unique(pairs, return_inverse=True)


def _corpus_counts(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Counts in the corpus, and numbers, of a block's words in order of their hashes."""
    order = np.argsort(answers["shard"].to_numpy())
    data, offset = answers["data"].to_pylist(), answers["first"].to_numpy()
    got = [(_split(data[i], 2), offset[i]) for i in order]
    none = [np.zeros(0, np.int64)]
    return np.concatenate([g[0].astype(np.int64) for g, _ in got] or none), np.concatenate([np.cumsum(g[1].astype(np.int64)) + o for g, o in got] or none)


def _base(c: np.ndarray, n: int, v: int) -> np.ndarray:
    return np.log10((c + 0.1) / (n + 0.1 * (v + 1)))


def score_words(n: int, v: int, shards: int):
    """Cogrouped applyInArrow of a block and its word counts: each text's counts and base score, and bigram requests.

    Rows (shard, block, data): requests, and with a negative shard, the counts and numbers of the block's words, base
    scores and known tokens, which pass the shards unchanged."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            _, rank, own = _words_of(r["words"], r["counts"])
            c = np.zeros(len(rank), np.int64)
            h = np.zeros(len(rank), np.uint64)
            c[rank], number = _corpus_counts(right)
            h[rank] = _u(number)
            ranks, ends = unpack(r["tokens"]).astype(np.int64), np.array(r["ends"], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            scores, known = np.add.reduceat(_base(c, n, v)[ranks], starts), np.add.reduceat((c > 0)[ranks].astype(np.int64), starts)
            pairs, at = _bigrams(ranks, ends)
            trained = np.repeat(~np.array(r["held"], bool), ends - starts)
            often = np.bincount(at[trained], minlength=len(pairs))
            context, word = pairs >> 32, pairs & 0xFFFFFFFF
            shard = _shard(h[context], h[word], c[context], n, shards)
            order = np.lexsort((h[word], h[context], shard))
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for s, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if hi > lo:
                    out.append((s, r["block"], _request(order[lo:hi], context, word, h, c, often)))
            own = _join([c, h, np.ascontiguousarray(scores).view(np.uint64), known])
            out.append((-1 - r["block"] % shards, r["block"], own))
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"shard": pa.array(cols[0], pa.int64()), "block": pa.array(cols[1], pa.int64()), "data": pa.array(cols[2], pa.binary())})

    return run


def _shard(context: np.ndarray, word: np.ndarray, count: np.ndarray, n: int, shards: int) -> np.ndarray:
    """By context; the words of a hot context are dealt to several shards, the more the larger its count."""
    salts = 1 + np.minimum(count * (SPLIT * shards) // max(n, 1), 255)
    key = tokens.mix(context + word % salts.astype(np.uint64))
    return (key >> np.uint64(32)).astype(np.int64) * shards >> 32


def _request(rows: np.ndarray, context: np.ndarray, word: np.ndarray, h: np.ndarray, c: np.ndarray, often: np.ndarray) -> bytes:
    """Contexts with how many words each has and its count; words, their counts, the bigrams'. All by number."""
    v = context[rows]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    sizes = np.diff(np.append(first, len(v)))
    return _join([np.diff(h[v[first]], prepend=np.uint64(0)), sizes, c[v[first]], h[word[rows]], c[word[rows]], often[rows]])


def answer_bigrams(n: int, v: int):
    """applyInArrow of a shard: adds the blocks' bigram counts, builds the trie, answers each block's lookups."""

    def run(table: pa.Table) -> pa.Table:
        if table["shard"][0].as_py() < 0:
            return table
        got = [_split(d, 6) for d in table["data"].to_pylist()]
        contexts = [np.repeat(np.cumsum(g[0]), g[1].astype(np.int64)).astype(np.int64) for g in got]
        words = [g[3].astype(np.int64) for g in got]
        of_context = [np.repeat(g[2], g[1].astype(np.int64)).astype(np.int64) for g in got]
        cs, ws, cc, cw, often = (np.concatenate(x) for x in (contexts, words, of_context, [g[4].astype(np.int64) for g in got], [g[5].astype(np.int64) for g in got]))
        order = np.lexsort((ws, cs))
        cs, ws, cc, cw, often = (x[order] for x in (cs, ws, cc, cw, often))
        new = np.concatenate([[True], (cs[1:] != cs[:-1]) | (ws[1:] != ws[:-1])])
        first = np.flatnonzero(new)
        total = np.add.reduceat(often, first)
        p = (total + MU * (cw[first] + 0.1) / (n + 0.1 * (v + 1))) / (cc[first] + MU)
        kept = total > 0
        trie = Trie(cs[first][kept], ws[first][kept], np.log10(p[kept]))
        answers = []
        for c, w in zip(contexts, words, strict=True):
            log = trie.log10(c, w)
            code = np.where(np.isnan(log), 0, np.rint(np.nan_to_num(log) / Trie.FLOOR * 65535) + 1)
            answers.append(pack(_u(code)))
        return pa.table({"shard": table["shard"], "block": table["block"], "data": pa.array(answers, pa.binary())})

    return run


def finish(n: int, v: int, shards: int):
    """Cogrouped applyInArrow of a block and its answers: a row for each text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for r in left.to_pylist():
            data = dict(zip(right["shard"].to_pylist(), right["data"].to_pylist(), strict=True))
            c, h, scores, known = _split(next(d for s, d in data.items() if s < 0), 4)
            c, scores = c.astype(np.int64), scores.view(np.float64)
            ranks, ends = unpack(r["tokens"]).astype(np.int64), np.array(r["ends"], np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            pairs, at = _bigrams(ranks, ends)
            context, word = pairs >> 32, pairs & 0xFFFFFFFF
            shard = _shard(h[context], h[word], c[context], n, shards)
            order = np.lexsort((h[word], h[context], shard))
            codes = np.concatenate([unpack(data[s]) for s in sorted(s for s in data if s >= 0)]).astype(np.int64)
            log = np.empty(len(pairs))
            log[order] = (codes - 1) * (Trie.FLOOR / 65535)
            back = np.log10(MU / (c[context] + MU)) + _base(c[word], n, v)
            none = np.empty(len(pairs), bool)
            none[order] = codes == 0
            log = np.where(none, back, log)
            out["doc_id"] += r["ids"]
            out["held_out"] += r["held"]
            out["n_tokens"].append(ends - starts)
            out["n_known"].append(known.astype(np.int64))
            out["base_score"].append(scores)
            out["score"].append(np.add.reduceat(log[at], starts))
        arrays = {k: pa.array(x, pa.int64() if k == "doc_id" else pa.bool_()) if k in ("doc_id", "held_out") else pa.array(np.concatenate(x) if x else [], pa.int64() if k.startswith("n_") else pa.float64()) for k, x in out.items()}
        return pa.table(arrays)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Rows whose crc32 of the id as text is divisible by `folds` are held out: scored, not learned from."""
    with scratch(docs.sparkSession):
        return kept(stage(_scored(docs, id_col, text_col, folds), "scores"))


def _scored(docs: DataFrame, id_col: str, text_col: str, folds: int) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.pmod(F.crc32(key), F.lit(folds)) == 0).alias("held"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = stage_by(base.mapInArrow(read_blocks, _BLOCK), "blocks", "block", max(parts, -(-size // (BUCKET_BLOCKS * BLOCK_BYTES))))
    total = blocks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    shards = max(2 * parts, -(-total // SHARD_TOKENS))
    packed = "shard bigint, block bigint, data binary"
    asked = blocks.select("block", "words", "counts").mapInArrow(word_requests(shards), packed)
    counts = stage(asked.groupBy("shard").applyInArrow(count_words, f"{packed}, size bigint, n bigint, v bigint"), "word-counts")
    n, v = (x or 0 for x in counts.agg(F.sum("n"), F.sum("v")).first())
    sizes = counts.groupBy("shard").agg(F.sum("size").alias("size"))
    first = sizes.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("first"))  # a row a shard
    numbered = counts.select("shard", "block", "data").join(bounded_broadcast(stage(first, "firsts")), "shard")
    met = blocks.groupBy("block").cogroup(numbered.groupBy("block")).applyInArrow(score_words(n, v, shards), packed)
    answers = met.groupBy("shard").applyInArrow(answer_bigrams(n, v), packed)
    kinds = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish(n, v, shards), kinds)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
