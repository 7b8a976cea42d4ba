"""Exact top-k search by multi-resolution segment statistics, coarse to fine.

Vectors are cut into 1, 2, 4, 8 and 16 segments, each with its mean and standard deviation. Scaled by the root of the
segment's length l, they bound the inner product from above: sum of l * (mean * mean + deviation * deviation), which is
(|a|**2 + |b|**2 - lower bound of the squared distance) / 2. So the bounds of all pairs of two blocks are one matrix
product a level, of 2 to 32 columns.

1. Rows are dealt to blocks by the signs of their segments' sums, as many bits as the table needs blocks, and within a
   sign pattern by hash, so a hot one is many blocks of bounded size.
2. Each query block meets one candidate block of its own pattern; the k-th best score so far is the query's threshold.
3. Every block has the envelope of its rows' statistics (4 segments). Pairs of blocks whose envelopes bound all scores
   below the least threshold are dropped whole. In the others each finer level drops the candidates whose bounds lie
   below the thresholds of all queries of a tile, and survivors are scored exactly, as a matrix product of integers
   where that is exact in floating point, else in wider integers.
A bound equal to the threshold survives, and bounds are widened by more than their rounding, so the answer is exact,
ties too. Every pair of blocks is one group of bounded size; a window keeps the k best of a query's blocks.

Defined results: null vectors, and those with null or non-finite components, take no part, nor do rows with a null id;
vectors are only compared with those of their length; all rows of a query's own id are left out of its candidates;
repeated rows are candidates each, but one query; an id with different vectors has a ranking for each of them under
the one query_id; an empty vector scores 0. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, kept, scratch, stage

#: Rows of a block; a pair of blocks is held in memory at once.
QUERY_BLOCK, ROW_BLOCK = 2_000, 8_000
#: Queries whose bounds are held at once.
TILE = 256
LEVELS = (1, 2, 4, 8, 16)
#: Segments of a block's envelope.
_COARSE = 4


def segment_statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of a level's segments, each scaled by the root of the segment's length."""
    edges = np.unique(np.linspace(0, x.shape[1], parts + 1).astype(int))
    lengths = np.diff(edges)
    means = np.add.reduceat(x, edges[:-1], axis=1) / lengths
    squares = np.add.reduceat(x * x, edges[:-1], axis=1) / lengths
    return np.concatenate([means, np.sqrt(np.maximum(squares - means * means, 0))], 1) * np.tile(np.sqrt(lengths), 2)


def _products(q: np.ndarray, c: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products of all pairs of integral rows; top bounds their size."""
    if top < 2**53:
        return q @ c.T
    if top < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = [np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (q, c)]
    return whole[0] @ whole[1].T


def block_best(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate id, score) of each query's k best in the block that are no less than its `least`."""
    top = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(c).max(initial=0)), 1.0) * max(q.shape[1], 1)
    parts = [p for p in LEVELS if p <= q.shape[1]] if top < 2**53 else []
    levels = [(segment_statistics(q, p), segment_statistics(c, p)) for p in parts]
    norms = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1)).max(initial=0)
    out: tuple[list, list, list] = ([], [], [])
    for first in range(0, len(q), TILE):
        tile = slice(first, first + TILE)
        floor = (least[tile] - 1e-9 * norms[0][tile] * norms[1] - 1e-6)[:, None]
        alive = np.arange(len(c))
        for own, theirs in levels:
            if not len(alive) or not np.isfinite(floor).all():
                break
            alive = alive[(own[tile] @ theirs[alive].T >= floor).any(0)]
        scores = _products(q[tile], c[alive], top)
        other = q_ids[tile][:, None] != c_ids[alive][None, :]
        if top < 2**53:
            ranked = np.where(other, scores, -np.inf)
            cut = least[tile]
            if len(alive) > k:
                cut = np.maximum(cut, np.partition(ranked, len(alive) - k, axis=1)[:, len(alive) - k])
            at, column = np.nonzero(other & (ranked >= cut[:, None]))
            value = scores[at, column].astype(np.int64)
        else:
            at, column = np.nonzero(other)
            value = scores[at, column]
        ids = c_ids[alive][column]
        order = np.lexsort((ids, -value, at)) if value.dtype != object else np.array(sorted(range(len(at)), key=lambda j: (at[j], -value[j], ids[j])), np.int64)
        at, value, ids = at[order], value[order], ids[order]
        begin = np.searchsorted(at, np.arange(len(q_ids[tile])))
        keep = np.arange(len(at)) - begin[at] < k
        out[0].append(at[keep] + first)
        out[1].append(ids[keep])
        out[2].append(value[keep])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _segments(v: Column, dim: Column, parts: int) -> list[tuple[Column, Column]]:
    """Sum and length of each of the segments of a level."""
    out = []
    for i in range(parts):
        begin, end = F.floor(dim * i / parts).cast("int"), F.floor(dim * (i + 1) / parts).cast("int")
        out.append((F.slice(v, begin + 1, end - begin), end - begin))
    return out


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def _statistics(v: Column, dim: Column) -> list[Column]:
    """The coarse level's scaled means and deviations; 0 for segments without components."""
    means, spread = [], []
    for part, n in _segments(v, dim, _COARSE):
        mean = _total(part) / F.greatest(n, F.lit(1))
        squares = _total(F.transform(part, lambda x: x * x)) / F.greatest(n, F.lit(1))
        means.append(F.when(n > 0, mean * F.sqrt(n)).otherwise(0.0))
        spread.append(F.when(n > 0, F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0))) * F.sqrt(n)).otherwise(0.0))
    return [*means, *spread]


def _dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """rows with the block that each belongs to: its length and pattern, and a part by hash of `size` rows, about."""
    many = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", "v"), F.col("parts"))
    return rows.join(bounded_broadcast(many), ["dim", "cell"]).withColumn(name, F.concat_ws(":", "dim", "cell", part)).drop("parts")


def _envelopes(rows: DataFrame, block: str, prefix: str, more: list[Column]) -> DataFrame:
    stats = [f"s{i}" for i in range(2 * _COARSE)]
    each = [f(s).alias(f"{prefix}{n}_{s}") for s in stats for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("dim", "cell", block).agg(*each, *more)


def top_k(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, every: int = 20, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for ids divisible by `every`, the k largest inner products of floor(scale * x)."""
    with scratch(vectors.sparkSession):
        return kept(stage(_top_k(vectors, k, id_col, vector_col, scale, every, query_block, row_block), "top"))


def _top_k(vectors: DataFrame, k: int, id_col: str, vector_col: str, scale: int, every: int, query_block: int, row_block: int) -> DataFrame:
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    base = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("v"))
    bits = min(12, max(0, (-(-vectors.count() // row_block) - 1).bit_length()))
    v, dim = F.col("v"), F.col("dim")
    signs = [F.when(_total(part) > 0, 1 << i).otherwise(0) for i, (part, _) in enumerate(_segments(v, dim, bits))]
    base = base.withColumn("dim", F.size("v")).withColumn("cell", sum(signs, F.lit(0)))
    rows = stage(_dealt(base.select("*", *[c.alias(f"s{i}") for i, c in enumerate(_statistics(v, dim))]), row_block, "cb"), "vectors")
    queries = rows.drop("cb").where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id", "v"])
    queries = stage(_dealt(queries, query_block, "qb").withColumn("q", F.monotonically_increasing_id()), "queries")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        a, b = [np.stack(t["v"].to_numpy()).astype(float).reshape(len(t), -1) for t in (left, right)]
        ids = left["id"].to_numpy()
        at, found, score = block_best(ids, a, left["least"].fillna(-np.inf).to_numpy(float), right["id"].to_numpy(), b, k)
        return pd.DataFrame({"q": left["q"].to_numpy()[at], "query_id": ids[at], "vec_id": found, "score": score})

    def scored(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """The best of each pair of blocks (qb, cb). asked: queries with their thresholds (least)."""
        pairs = bounded_broadcast(pairs.select("qb", "cb"))
        left = asked.select("qb", "q", "id", "v", "least").join(pairs, "qb").groupBy("qb", "cb")
        right = rows.select("cb", "id", "v").join(pairs, "cb").groupBy("qb", "cb")
        return left.cogroup(right).applyInPandas(meet, "q bigint, query_id bigint, vec_id bigint, score bigint")

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    own = rows.groupBy("dim", "cell").agg(F.min("cb").alias("cb"))
    first = stage(queries.select("dim", "cell", "qb").distinct().join(own, ["dim", "cell"]).select("qb", "cb"), "first")
    near = stage(scored(queries.withColumn("least", F.lit(None).cast("double")), first), "near")
    reached = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("q", F.col("score").cast("double").alias("least"))
    asked = stage(queries.join(reached, "q", "left"), "asked")

    open_ = F.min(F.coalesce("least", F.lit(float("-inf")))).alias("least")
    blocks = _envelopes(asked, "qb", "q", [open_]).drop("cell").join(_envelopes(rows, "cb", "c", []).drop("cell"), "dim")
    most = sum((F.greatest(*[F.col(f"q{n}_s{i}") * F.col(f"c{m}_s{i}") for n in ("lo", "hi") for m in ("lo", "hi")]) for i in range(2 * _COARSE)), F.lit(0.0))
    rest = blocks.where(most + F.abs(most) * 1e-6 + 1.0 >= F.col("least")).select("qb", "cb").join(first, ["qb", "cb"], "left_anti")
    best = near.union(scored(asked, stage(rest, "rest")))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
