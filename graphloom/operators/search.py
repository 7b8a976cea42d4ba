"""Symbol search: browsing, prefix search with BM25 ranking, substring search."""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranking constants and result limits (fixed values).
K1, B = 1.2, 0.75
PREFIX_LIMIT, SUBSTRING_LIMIT = 80, 100


def _bases() -> dict[str, str]:
    """Characters whose canonical decomposition without combining marks is one other character, with that one."""
    out = {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(base) == 1 and base != c:
            out[c] = base
    return out


#: Translation tables of fold() and of its column form.
BASES = _bases()
_FOLD = str.maketrans(BASES)


def fold(text: str) -> str:
    """In lower case and without accents, composed or combining."""
    return "".join(c for c in text.lower().translate(_FOLD) if unicodedata.category(c) != "Mn")


def folded(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(text), "".join(BASES), "".join(BASES.values())), r"\p{Mn}+", "")


def browse(symbols: DataFrame) -> DataFrame:
    """All symbols, by qualified name in any case, then id."""
    return symbols.orderBy(F.lower("fqn"), "symbol_id")


def query_terms(query: str) -> list[list[str]]:
    """Terms of a query, each as the adjacent tokens it stands for; the last is a prefix. Operator words are plain."""
    terms = [t for t in re.split(r"[^\w]+", fold(query)) if t.strip("_")]
    return [[p for p in t.split("_") if p] for t in terms]


def index_tokens(symbols: DataFrame) -> DataFrame:
    """symbols with `tokens`: the words of name, signature and path, in any case and without accents."""
    text = F.concat_ws(" ", "fqn", "signature", "relative_path")
    return symbols.withColumn("tokens", F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def term_count(tokens: Column, term: list[str]) -> Column:
    """How often the term's tokens stand in a row, the last as a prefix."""
    if len(term) == 1:
        return F.size(F.filter(tokens, lambda t: t.startswith(term[0])))
    last = len(term) - 1

    def here(_: Column, i: Column) -> Column:
        out = F.coalesce(F.get(tokens, i + last).startswith(term[last]), F.lit(False))
        for k, word in enumerate(term[:-1]):
            out = out & (F.get(tokens, i + k) == word)
        return out

    return F.size(F.filter(tokens, here))


def search(symbols: DataFrame, query: str, limit: int = PREFIX_LIMIT) -> DataFrame:
    """(symbol_id, fqn, score): symbols that hold every term, best first. A blank query browses, without limit.

    BM25 over the symbols of the repository; one pass for the statistics (a row), one for the scores."""
    terms = query_terms(query)
    if not terms:
        return browse(symbols).select("symbol_id", "fqn", F.lit(0.0).alias("score")) if not query.strip() else symbols.select("symbol_id", "fqn", F.lit(0.0).alias("score")).limit(0)
    indexed = index_tokens(symbols).select("symbol_id", "fqn", F.size("tokens").alias("len"), *[term_count(F.col("tokens"), t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = indexed.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    return ranked(indexed, stats, len(terms), limit)


def ranked(counted: DataFrame, stats: DataFrame, terms: int, limit: int) -> DataFrame:
    """(symbol_id, fqn, score) of rows (symbol_id, fqn, len, tf0 ..) that hold every term, best first.

    stats: one row of n, avg_len and df0 .."""
    met = counted.where(" and ".join(f"tf{i} > 0" for i in range(terms))).join(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(terms):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return met.select("symbol_id", "fqn", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "fqn", "symbol_id").limit(limit)


def search_substring(symbols: DataFrame, query: str, limit: int = SUBSTRING_LIMIT) -> DataFrame:
    """The first symbols, in order of name and id, whose fields hold the query in any case."""
    text = F.lower(F.concat_ws(" ", "fqn", "signature", "relative_path", "kind", "language"))
    return symbols.where(F.contains(text, F.lit(query.lower()))).orderBy("fqn", "symbol_id").limit(limit)
