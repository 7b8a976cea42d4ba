"""Source trees as DataFrames: file listing, bounded reads, Git metadata."""

from __future__ import annotations

import subprocess
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import fnv64_text
from ..functions.names import is_excluded, language_of, normalize_path, source_lines

#: Limits (fixed values): bytes of a file, files of an analysis in the web variant.
MAX_BYTES, MAX_FILES = 2 * 1024 * 1024, 5_000


def read_sources(spark: SparkSession, root: str, ignored: DataFrame | None = None, web: bool = False) -> DataFrame:
    """(relative_path, language, length, text, content_fingerprint, reason) of every file that a language claims.

    reason is null for a readable one, else too_large (strictly over the limit), outside (a link that leaves the root)
    or not_utf8. A file that is too large isn't opened; empty files aren't listed (Spark's reader passes over them). ignored: DataFrame with column relative_path. web: suffixes in
    any case, excluded folders pruned, the first MAX_FILES by path."""
    base = root.rstrip("/") + "/"
    read = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = read().select("path", "length")  # the listing alone: contents aren't read for it
    path = normalize_path(F.element_at(F.split(F.col("path"), r"\Q" + base + r"\E", 2), -1))
    listed = listed.withColumn("relative_path", path).withColumn("language", language_of(F.col("relative_path"), any_case=web)).where("language is not null")
    listed = listed.where(~is_excluded(F.col("relative_path"))) if web else listed
    listed = listed.join(ignored, "relative_path", "left_anti") if ignored is not None else listed
    listed = listed.orderBy("relative_path").limit(MAX_FILES) if web else listed
    away = _outside(F.col("path"), F.lit(root))
    small = read().where(F.col("length") <= MAX_BYTES).select("path", "content")  # the reader skips larger files
    met = listed.withColumn("away", away).join(small, "path", "left")
    good = ~F.col("away") & F.is_valid_utf8(F.col("content"))
    text = F.when(good, F.decode("content", "UTF-8"))
    reason = F.when(F.col("length") > MAX_BYTES, "too_large").when(F.col("away"), "outside").when(~F.coalesce(good, F.lit(False)), "not_utf8")
    return met.select("relative_path", "language", "length", text.alias("text"), fnv64_text(text).alias("content_fingerprint"), reason.alias("reason"))


@F.pandas_udf(T.BooleanType())
def _outside(paths: pd.Series, root: pd.Series) -> pd.Series:
    """A path whose links lead out of the root. Only where the file system is mounted can a path be a link."""
    local = lambda p: Path(p.removeprefix("file:").replace("//", "/"))
    return pd.Series([not local(p).resolve().is_relative_to(local(r).resolve()) for p, r in zip(paths, root, strict=True)])


def _git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    return done.stdout.decode("utf-8", "ignore") if done.returncode == 0 else None


def inspect(spark: SparkSession, root: str) -> DataFrame:
    """One row: root_path, display_name, branch, head (short) and is_dirty of a work tree. Reads only."""
    if not Path(root).is_dir():
        raise ValueError(f"not a directory: {root}")
    top = _git(root, "rev-parse", "--show-toplevel")
    if top is None:
        raise ValueError(f"not a Git work tree: {root}")
    branch = (_git(root, "symbolic-ref", "--short", "-q", "HEAD") or "").strip() or "detached HEAD"
    head = (_git(root, "rev-parse", "--short", "HEAD") or "").strip()
    dirty = bool(_git(root, "status", "--porcelain", "--untracked-files=all"))
    row = (top.strip(), Path(top.strip()).name, branch, head, dirty)
    return spark.createDataFrame([row], "root_path string, display_name string, branch string, head string, is_dirty boolean")


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, language): tracked and untracked files, less ignored ones, of a supported language."""
    names = (_git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard") or "").split("\0")
    df = spark.createDataFrame([(n,) for n in names if n], "relative_path string").distinct()
    return df.withColumn("language", language_of(F.col("relative_path"))).where("language is not null")


def changed_files(spark: SparkSession, root: str, revision: str) -> DataFrame:
    """Supported paths that differ from a revision, and untracked ones."""
    a = (_git(root, "diff", "--name-only", "-z", revision) or "").split("\0")
    b = (_git(root, "ls-files", "-z", "--others", "--exclude-standard") or "").split("\0")
    df = spark.createDataFrame([(n,) for n in {*a, *b} if n], "relative_path string")
    return df.where(language_of(F.col("relative_path")).isNotNull())


def read_source(spark: SparkSession, root: str, relative_path: str) -> DataFrame:
    """(relative_path, text) of one file, which must lie within the root."""
    file = (Path(root) / relative_path).resolve()
    if not file.is_relative_to(Path(root).resolve()):
        raise ValueError("the path leaves the repository")
    return spark.read.text(str(file), wholetext=True).select(F.lit(relative_path).alias("relative_path"), F.col("value").alias("text"))


def source_for_symbol(spark: SparkSession, root: str, symbols: DataFrame, repository_id: str, symbol_id: str) -> DataFrame:
    """(symbol_id, relative_path, start_line, end_line, text): the lines of one symbol, from its file."""
    row = symbols.where((F.col("repository_id") == repository_id) & (F.col("symbol_id") == symbol_id)).select("symbol_id", "relative_path", "start_line", "end_line").first()
    if row is None:
        raise ValueError(f"no symbol {symbol_id} in {repository_id}")
    whole = read_source(spark, root, row["relative_path"])
    lines = source_lines(F.col("text"), F.lit(row["start_line"]), F.lit(row["end_line"]))
    return whole.select(F.lit(row["symbol_id"]).alias("symbol_id"), "relative_path", F.lit(row["start_line"]).alias("start_line"), F.lit(row["end_line"]).alias("end_line"), lines.alias("text"))
