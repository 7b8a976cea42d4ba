"""Token-id files: Parquet list columns in ascending document order, with metadata that can be read without the tokens.

Layout: one folder of Parquet files, in the order of their names. Columns: doc_id, n_tokens, start_in_file (ids of
all documents before it in its file), file_no, ids_crc32, tokens (list of int). Row groups hold a bounded number of
bytes, pages are small, and Parquet's column and offset indexes are on, so a reader of a doc_id range or of metadata
columns touches only those pages. Integers are delta encoded (format v2), or dictionary encoded, by parameter.
The manifest (file_no, first id, documents, tokens, start) is one row a file.

Documents are split by ranges of doc_id, sorted within them, encoded in that order and written by Spark's committed
writer, so a lost executor costs its tasks only. Encoding goes through the tokenizers library. A text is cut at single
spaces between characters that aren't white space: the byte-level pattern always begins a token there, so the pieces'
ids in a row are the text's ids. The pieces of many texts are numbered, and each different one is cut once, into what
the pattern tells apart; the library is asked for those parts' ids once, as they are kept in a bounded table.

Defined results: null text is an empty one; an empty text has the end id alone; null doc_ids come first; documents
with equal doc_id are ordered by text; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, new_path, slices, trimmed

END_ID = 2
#: Parts that a worker's table holds (beyond, it begins anew with those of the texts at hand), and the characters of a part
#: that is kept: some 40 bytes a part of usual length, however long the parts of the texts are.
KEPT_PIECES, KEPT_CHARS = 700_000, 64
#: Strings, or words in one string, that the library is asked for at a time; bytes of text that are encoded at a time.
ASKED, TEXT_BYTES = 256, 4 << 20
#: White space of any definition that isn't plain; next to these no cut is made.
_EXOTIC = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_ODD = "\\s" + _EXOTIC.pattern[1:-1]
_CUT = re.compile(f"(?<=[^{_ODD}]) (?=[^{_ODD}])")
#: Where texts can't be cut at every space.
_UNCUT = r"^ | $|[\t-\r ] | [\t-\r]|" + _EXOTIC.pattern
#: The byte-level pattern, where no exotic white space is; letters and numbers in a row are one part.
_PART = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W_]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: How the byte-level alphabet writes a space.
_SPACE = chr(288)

_encoders: dict[str, "PieceEncoder"] = {}


def _gather(ids: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' ids in a row, where row r is ids[begin[r]:begin[r + 1]], and the place before and after each."""
    length = np.diff(begin)[rows]
    ends = np.concatenate([[0], np.cumsum(length)])
    where = np.repeat((begin[rows] - ends[:-1]).astype(np.int32), length)
    where += np.arange(len(where), dtype=np.int32)
    return ids[where], ends


class _Parts:
    """Parts of texts and their ids, got when first asked for; found by a hash, then compared."""

    def __init__(self, learn):
        self.learn = learn
        self.names, self.ids, self.begin = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.sorted, self.order = np.zeros(0, np.int64), np.zeros(0, np.int32)  # hashes of the names, and whose they are

    def __iter__(self) -> Iterator[str]:
        return iter(self.names.to_pylist())

    def _find(self, names: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The names' rows; -1 where there is none."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.order) - 1)
        row, same = self.order[at].astype(np.int64), self.sorted[at] == hashes
        same[same] = pc.equal(names.filter(pa.array(same)), self.names.take(pa.array(row[same]))).to_numpy(zero_copy_only=False)
        return np.where(same, row, -1)

    def get(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _gather()."""
        coded = pa.array(parts, pa.string()).dictionary_encode()
        names, at = coded.dictionary, coded.indices.to_numpy()
        hashes = np.empty(len(names), np.int64)
        hashes[at] = np.fromiter(map(hash, parts), np.int64, len(parts))
        row = self._find(names, hashes)
        new = np.flatnonzero(row < 0)
        if not len(new):
            return _gather(self.ids, self.begin, row[at])
        place = np.empty(len(names), np.int64)
        place[at] = np.arange(len(at))
        ids, begin = self.learn([parts[i] for i in place[new].tolist()])
        row[new] = len(self.names) + np.arange(len(new))
        ids, begin = np.concatenate([self.ids, ids]), np.concatenate([self.begin, self.begin[-1] + begin[1:]])
        got = _gather(ids, begin, row[at])
        short = pc.less_equal(pc.utf8_length(names), KEPT_CHARS).to_numpy(zero_copy_only=False)
        if len(self.names) + len(new) > KEPT_PIECES:
            self.names, self.sorted, self.order = self.names[:0], self.sorted[:0], self.order[:0]
            self.ids, self.begin = _gather(ids, begin, row[short][:KEPT_PIECES])
            self._add(names.filter(pa.array(short))[:KEPT_PIECES], hashes[short][:KEPT_PIECES])
        else:
            if not short[new].all():
                ids, begin = _gather(ids, begin, np.concatenate([np.arange(len(self.names)), row[new[short[new]]]]))
            self.ids, self.begin = ids, begin
            new = new[short[new]]
            self._add(names.take(pa.array(new)), hashes[new])
        return got

    def _add(self, names: pa.Array, hashes: np.ndarray) -> None:
        rising = np.argsort(hashes).astype(np.int32)
        place = np.searchsorted(self.sorted, hashes[rising])
        self.sorted, self.order = np.insert(self.sorted, place, hashes[rising]), np.insert(self.order, place, rising + len(self.names))
        self.names = pa.concat_arrays([self.names, names])


class PieceEncoder:
    """Token ids of texts, as unsigned 32-bit integers, by way of a table of their parts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.uncut = "|".join([_UNCUT, *map(re.escape, self.special)])
        self.whole = self.bare = self.spaced = _Parts(self._learn)  # a part's name has the space before it, if any
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(names.values()) + 1, bool)  # tokens that begin with a space
        self.begins[[i for name, i in names.items() if name[0] == _SPACE]] = True

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        few = (texts[i : i + ASKED] for i in range(0, len(texts), ASKED))
        return [np.array(x.ids, "<u4") for t in few for x in self.tokenizer.encode_batch_fast(t, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, and where each begins. Words with a space before them are asked for in rows."""
        word = np.array([p[0] == " " and len(p) <= KEPT_CHARS and p[1:].isalpha() for p in parts], bool)
        words, others = [p for p, w in zip(parts, word, strict=True) if w], [p for p, w in zip(parts, word, strict=True) if not w]
        got = np.concatenate([np.zeros(0, "<u4"), *self._ask(["".join(words[i : i + ASKED]) for i in range(0, len(words), ASKED)])])
        own = self._ask(others)
        begin = np.concatenate([np.flatnonzero(self.begins[got]), len(got) + np.cumsum([0, *map(len, own)])])
        row = np.empty(len(parts), np.int64)
        row[word], row[~word] = np.arange(len(words)), len(words) + np.arange(len(others))
        return _gather(np.concatenate([got, *own]), begin, row)

    def _cut(self, text: str) -> list[str]:
        """Parts of a text of any kind; what exotic white space is in is one part."""
        if any(x in text for x in self.special):  # its string may span pieces
            return [text]
        if not _EXOTIC.search(text):
            return _PART.findall(text)
        first, *rest = _CUT.split(text)
        return [part for p in [first, *[" " + p for p in rest]] for part in ([p] if _EXOTIC.search(p) else _PART.findall(p))]

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with its end id, and how many each has."""
        texts = pc.fill_null(texts, "")
        uncut = pc.match_substring_regex(texts, self.uncut)
        lists = pc.split_pattern(pc.if_else(uncut, "", texts), " ")
        pieces, starts = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_numpy()])
        later = np.ones(len(pieces), bool)
        later[starts[:-1]] = False
        numbered = pieces.filter(pa.array(later)).dictionary_encode()
        # each different later piece once, with a space before it: ids that begin with a space show where pieces begin
        n = len(numbered.dictionary)
        parts = _PART.findall(" " + pc.binary_join(pa.ListArray.from_arrays([0, n], numbered.dictionary), " ")[0].as_py()) if n else []
        owned = [len(parts)]
        for i, (odd, first) in enumerate(zip(uncut.to_pylist(), pieces.take(pa.array(starts[:-1])).to_pylist(), strict=True)):
            parts += self._cut(texts[i].as_py() if odd else first)
            owned.append(len(parts))
        ids, ends = self.spaced.get(parts)
        own = ends[owned]
        begin = np.concatenate([np.flatnonzero(self.begins[ids[: own[0]]]), own, [len(ids) + 1]])
        # rows text by text: its first piece (or all of it), the later ones, the end
        at = starts + np.arange(len(starts))
        rows = np.empty(at[-1], np.int64)
        later = np.ones(len(rows), bool)
        later[at[:-1]] = later[at[1:] - 1] = False
        rows[later] = numbered.indices.to_numpy()
        rows[at[:-1]], rows[at[1:] - 1] = n + np.arange(len(texts)), n + len(texts)
        ids, ends = _gather(np.append(ids, np.array([end_id], "<u4")), begin, rows)
        return ids, np.diff(ends[at])

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        got, counts = self.ids(pa.array(texts, pa.string()), end_id)
        ends = np.cumsum(counts)
        return [got[a:b].tobytes() for a, b in zip(ends - counts, ends, strict=True)]


def encoder(path: str, end_id: int):
    """mapInArrow function over sorted documents (doc_id, text): one output file's rows, with running starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool = _encoders.get(path) or _encoders.setdefault(path, PieceEncoder(path))
        number, start = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", TEXT_BYTES):
            ids, counts = tool.ids(batch.column(1), end_id)
            ends = np.concatenate([[0], np.cumsum(counts)])
            tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            crcs = np.array([zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)
            files = np.full(len(counts), number, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(start + ends[:-1]), pa.array(files), pa.array(crcs), tokens], names=["doc_id", "n_tokens", "start_in_file", "file_no", "ids_crc32", "tokens"])
            start += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, row_group_mb: int = 64, page_kb: int = 256, dictionary: bool = False) -> str:
    """Encode and write; returns the folder."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = base.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    coded = ordered.mapInArrow(trimmed(encoder(tokenizer_path, end_id)), "doc_id bigint, n_tokens bigint, start_in_file bigint, file_no int, ids_crc32 bigint, tokens array<int>")
    options = {"parquet.block.size": row_group_mb << 20, "parquet.page.size": page_kb << 10, "parquet.writer.version": "v2", "parquet.enable.dictionary": str(dictionary).lower(), "compression": "zstd"}
    coded.write.options(**options).parquet(path)
    return path


def manifest(files: DataFrame) -> DataFrame:
    """(file_no, first_id, documents, tokens, start), one row a file; reads metadata columns alone."""
    each = files.groupBy("file_no").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    return each.withColumn("start", F.sum("tokens").over(Window.orderBy("file_no")) - F.col("tokens"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, with start: ids of all documents before. Columns that aren't asked for aren't read."""
    files = spark.read.parquet(path)
    index = manifest(files).select("file_no", "start")
    index = F.broadcast(index) if int(spark.conf.get("spark.sql.shuffle.partitions")) <= BROADCAST_ROWS else index
    return files.join(index, "file_no").withColumn("start", F.col("start") + F.col("start_in_file"))


def ids_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, start, tokens) to (doc_id, start, n_tokens, ids_crc32), from the ids as read."""
    for batch in batches:
        lists = batch.column(2)
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        crcs = np.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends)), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_index(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the documents' token files and return, from the files, (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = write_tokens(docs, path or new_path(spark, "token-files"), tokenizer_path, **options)
    return read_tokens(spark, path).select("doc_id", "start", "tokens").mapInArrow(trimmed(ids_digest), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
