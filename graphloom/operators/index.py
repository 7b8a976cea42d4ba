"""The search index that is kept: postings by token, in segments, one for each analysis of a repository.

A segment holds the postings of the symbols that an analysis added or changed, and the ids of those it removed or changed;
a posting counts if no later segment names its symbol. Postings lie in folders by the first bytes of their token (buckets)
and are sorted by token in them, so that a term, or a prefix, reads its own buckets and of these the row groups that may
hold it. A posting carries its symbol's name and length: nothing else is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search as plain

_POSTINGS = "token string, symbol_id string, fqn string, len int, positions array<int>, bucket string"
#: What of a symbol the index holds.
_FIELDS = ["symbol_id", "fqn", "signature", "relative_path"]


def bucket(token: Column) -> Column:
    """The first byte and a half of the token, in hex: of tokens that begin with two bytes or more, one bucket."""
    return F.substring(F.hex(F.encode(token, "UTF-8")), 1, 3)


def _in_buckets(prefix: str) -> Column:
    digits = prefix.encode().hex().upper()
    return F.col("bucket") == digits[:3] if len(digits) > 2 else F.col("bucket").startswith(digits)


def postings(symbols: DataFrame) -> DataFrame:
    """(token, symbol_id, fqn, len, positions, bucket) of symbols: a row for each of a symbol's tokens."""
    rows = plain.index_tokens(symbols).select("symbol_id", "fqn", F.size("tokens").alias("len"), "tokens", F.explode(F.array_distinct("tokens")).alias("token"))
    at = F.filter(F.transform("tokens", lambda t, i: F.when(t == F.col("token"), i)), lambda i: i.isNotNull())
    return rows.select("token", "symbol_id", "fqn", "len", at.alias("positions"), bucket(F.col("token")).alias("bucket"))


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(others[c]) for c in _FIELDS])
    return rows.join(others, same, "left_anti")


def write_segment(folder: str, old: DataFrame, new: DataFrame) -> tuple[int, int]:
    """Write what turns the index of `old` symbols into that of `new` ones: by how many symbols and tokens it grows."""
    added, gone = _without(new, old.select(*_FIELDS)), _without(old, new.select(*_FIELDS))
    # ranges of (bucket, token, symbol) share a hot token among tasks
    rows = postings(added).repartitionByRange("bucket", "token", "symbol_id").sortWithinPartitions("bucket", "token")
    rows.write.partitionBy("bucket").parquet(f"{folder}/postings")
    gone.select("symbol_id").distinct().write.parquet(f"{folder}/gone")
    sums = lambda part: plain.index_tokens(part).agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    (more, long), (less, short) = sums(added), sums(gone)
    return more - less, long - short


def read(spark: SparkSession, segments: list[str], wanted: Column) -> DataFrame:
    """The postings that count, of those wanted (a condition on bucket and token)."""
    parts = []
    for i, folder in enumerate(segments):
        own = spark.read.schema(_POSTINGS).parquet(f"{folder}/postings").where(wanted)
        later = [f"{f}/gone" for f in segments[i + 1 :]]
        if later:
            own = own.join(spark.read.schema("symbol_id string").parquet(*later).distinct(), "symbol_id", "left_anti")
        parts.append(own)
    return reduce(DataFrame.unionByName, parts)


def search(spark: SparkSession, segments: list[str], n: int, length: int, symbols: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(symbol_id, fqn, score): as the plain search of the symbols that the segments index.

    n, length: symbols of the index, and their tokens. symbols: read by a blank query alone."""
    terms = plain.query_terms(query)
    if not terms or not segments:
        return plain.search(symbols, query) if not terms else symbols.select("symbol_id", "fqn", F.lit(0.0).alias("score")).limit(0)
    tests = [[F.col("token").startswith(t) if j == len(term) - 1 else F.col("token") == t for j, t in enumerate(term)] for term in terms]
    any_of = reduce(lambda a, b: a | b, [_in_buckets(t) & test for term, own in zip(terms, tests, strict=True) for t, test in zip(term, own, strict=True)])
    places = [F.flatten(F.collect_list(F.when(test, F.col("positions")))).alias(f"p{i}_{j}") for i, own in enumerate(tests) for j, test in enumerate(own)]
    found = read(spark, segments, any_of).groupBy("symbol_id", "fqn", "len").agg(*places)

    def times(i: int, size: int) -> Column:
        """Where the term's tokens stand in a row."""
        here = lambda p: reduce(lambda a, b: a & b, [F.array_contains(f"p{i}_{j}", p + j) for j in range(1, size)], F.lit(True))
        return F.size(F.filter(f"p{i}_0", here)).alias(f"tf{i}")

    counted = found.select("symbol_id", "fqn", "len", *[times(i, len(t)) for i, t in enumerate(terms)])
    stats = counted.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).withColumns({"n": F.lit(n), "avg_len": F.lit(length / n if n else 0.0)})
    return plain.ranked(counted, stats, len(terms), plain.PREFIX_LIMIT if limit is None else limit)
