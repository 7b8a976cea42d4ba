"""What the corpus operators share: staged tables, size-checked broadcasts, row keys and Arrow slices."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that a side may hold to be broadcast; more take a shuffled join instead.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 128 << 20

#: Rows of a key from which it counts as hot, and isn't left to one task of a shuffled join.
HOT_ROWS = 100_000

_own_dir: list[str] = []


class _Open(threading.local):
    """Paths staged in each open scratch() of a thread, the innermost last."""

    def __init__(self) -> None:
        self.stack: list[dict[str, str | None]] = []


_open = _Open()
#: Tables that outlive every scratch(): (session, path, table's name), until release() or the end of the process.
_left: list[tuple[SparkSession, str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, in local mode alone, a folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="graphloom-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged in the block are deleted at its end, but those that are kept().

    What leaves the block must be staged itself, and kept: by then it is committed, so that a lost executor rereads it
    and never asks for a table that is gone."""
    _open.stack.append({})
    try:
        yield
    finally:
        for path, table in _open.stack.pop().items():
            _delete(spark, path, table)


def _delete(spark: SparkSession, path: str, table: str | None = None) -> None:
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and lost executors cost a reread."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    if _open.stack:
        _open.stack[-1][path] = None
    got = spark.read.schema(df.schema).parquet(path)
    got._staged_at = path
    return got


def kept(df: DataFrame) -> DataFrame:
    """This staged table outlives the innermost scratch(); it belongs to the one around it, if any, else to the process:
    release() deletes it, or the end of the process."""
    table = _open.stack[-1].pop(df._staged_at)
    if len(_open.stack) > 1:
        _open.stack[-2][df._staged_at] = table
    else:
        if not _left:
            atexit.register(release)
        _left.append((df.sparkSession, df._staged_at, table))
    return df


def release() -> None:
    """Delete what operators returned so far: none of their results can be read again."""
    while _left:
        with suppress(Exception):  # a session that has ended leaves its tables
            _delete(*_left.pop())


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables before their scratch() ends; nothing that is still to be computed may read them."""
    for df in tables:
        path = df._staged_at
        name = next((opened.pop(path) for opened in reversed(_open.stack) if path in opened), None)
        _left[:] = [kept for kept in _left if kept[1] != path]
        _delete(df.sparkSession, path, name)


def stage_by(df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
    """stage(), as a table bucketed by a column: later groupings by it read the files without a shuffle."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    name = f"graphloom_{label}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(name)
    if _open.stack:
        _open.stack[-1][path] = name
    got = spark.table(name)
    got._staged_at = path
    return got


def _weight(kind: T.DataType, c: Column) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        each = 8 * len(inner.fields) + 8 if isinstance(inner, T.StructType) else 40 if isinstance(inner, T.StringType) else 8
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * each + 24
    if isinstance(kind, T.StructType):
        return sum((_weight(f.dataType, c[f.name]) for f in kind.fields), F.lit(16))
    return F.lit(8)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """df, which should be staged or cheap, has no more rows and about no more bytes: both are counted here."""
    each = sum((_weight(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(16)).cast("long")
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return n <= rows and held <= size


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it fits_broadcast, and else as it is, for a shuffled join."""
    return F.broadcast(df) if fits_broadcast(df, rows, size) else df


def keyed_join(left: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """left with the columns of side, which has one row a key; null where it has none.

    side is broadcast if it fits; else rows without a key go by, hot keys meet their rows of side as a broadcast (there
    are at most rows / HOT_ROWS of them), and the others meet by a shuffle."""
    if fits_broadcast(side):
        return left.join(F.broadcast(side), key, "left")
    columns = [*left.columns, *(c for c in side.columns if c != key)]
    hot = stage(left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).select(key), "hot")
    none = left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema.fields if f.name != key])
    rest = left.where(F.col(key).isNotNull())
    few = rest.join(bounded_broadcast(hot), key, "left_anti").join(side, key, "left")
    many = rest.join(bounded_broadcast(hot), key, "left_semi").join(bounded_broadcast(side.join(bounded_broadcast(hot), key, "left_semi")), key, "left")
    return few.select(columns).union(many.select(columns)).union(none.select(columns))


def row_key(*cols: str) -> Column:
    """16 bytes for a row's own columns (two seeded 64-bit hashes); nulls and empty strings differ."""
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (1, 2)]
    return F.unhex(F.concat(*halves))


def trimmed(run):
    """A mapInArrow function that gives the memory it freed back to the system at its end: a Python worker lives on."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # a libc without it keeps its pages
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the text of each part has about `limit` bytes; a longer text is a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = text_offsets(column)[1:]
        begin, base = 0, text_offsets(column)[0]
        while begin < batch.num_rows:
            end = int(np.searchsorted(ends, base + limit, side="right"))
            end = max(begin + 1, end)
            yield batch.slice(begin, end - begin)
            base, begin = ends[end - 1], end


def text_offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(1, np.int64)
    got = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize)
    return got.astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins and ends (rows + 1 offsets). Null texts are empty."""
    offsets = text_offsets(column)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if column.null_count:  # a null's bytes are unspecified; take them out
        lengths, nulls = np.diff(offsets), ~np.asarray(column.is_valid())
        if lengths[nulls].any():
            keep = np.repeat(~nulls, lengths)
            lengths = np.where(nulls, 0, lengths)
            raw, offsets = raw[keep], np.concatenate([[0], np.cumsum(lengths)])
    return raw, offsets
