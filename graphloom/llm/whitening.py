"""Embedding whitening: distributed centred scatter, cyclic Jacobi rotations on the driver, whitening matrix to all tasks.

Components of a vector become whole numbers x = floor(scale * c). The fit list holds each distinct x vector once; its
sums, then its scatter around the rounded mean, are added up exactly (as integers) by partition, then by FAN parts, then
in one task, so neither order nor partitioning changes a bit of the covariance and the driver gets one matrix. Jacobi
rotations run over all pairs of dimensions, sweep by sweep, until every off-diagonal entry vanishes beside its two
diagonal ones, which keeps small eigenvalues accurate. Eigenvectors are signed so that their largest entry is positive.

The driver and each task hold matrices of dimension x dimension numbers, whatever the rows; more than MAX_DIMENSION
dimensions raise an error.

Defined results: vectors that are null, empty or hold null or non-finite entries take no part; of vectors of several
lengths those of the commonest length do (ties: the longer); entries beyond 64 bits after scaling stand at their limit;
a deviation beyond 64 bits is null; components whose variance is zero to double precision have null whitened values;
where all variance is zero, explained is null; repeated rows get a result each and count once in the fit; an empty table
gives an empty one; ids may be null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stage, trimmed

#: Dimensions of which the driver and a task hold a square matrix.
MAX_DIMENSION = 4096
#: Parts in which partial sums meet before the last task.
FAN = 32
_LIMIT = 1 << 63


def scaled(table: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, x): rows whose vectors have entries, all finite, as whole numbers."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.col("_v").isNotNull() & (F.size("_v") > 0) & finite).select("vec_id", F.transform("_v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: str, dim: int, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            values = part.column(part.schema.get_field_index(column)).flatten()
            yield part, values.to_numpy(zero_copy_only=False).reshape(-1, dim)


def _folded(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], tuple]) -> tuple | None:
    """The sum of what `partial` makes of every partition: a tuple of arrays, added entry by entry. None without rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = partial(batches)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], names=["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column(0):
                part = pickle.loads(value.as_py())
                total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    parts = rows.mapInArrow(trimmed(each), "part binary").repartition(FAN).mapInArrow(trimmed(add), "part binary")
    got = parts.repartition(1).mapInArrow(trimmed(add), "part binary").first()
    return pickle.loads(got["part"]) if got else None


def _sums(dim: int):
    def partial(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        n, total = 0, np.zeros(dim, object)
        for _, x in _matrices(batches, "x", dim):
            n += len(x)
            total = total + (x.sum(0).astype(object) if np.abs(x.astype(float)).max(initial=0) < 1 << 50 else x.astype(object).sum(0))
        return (n, total) if n else None

    return partial


def _products(dim: int, centre: np.ndarray):
    """Exact products of centred entries, summed: whole numbers under 2**53 pass through doubles unchanged."""

    def partial(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        total, some = np.zeros((dim, dim), object), False
        for _, x in _matrices(batches, "x", dim):
            some = some or len(x) > 0
            spread = np.abs(x.astype(float)).max(initial=0) + max(abs(int(c)) for c in centre)
            if spread < 1 << 26:
                d = (x - centre.astype(np.int64)).astype(float)
                step = max(1, int((1 << 53) // (int(spread) ** 2 + 1)))
                for at in range(0, len(d), step):
                    part = d[at : at + step]
                    total = total + (part.T @ part).astype(np.int64).astype(object)
            else:
                d = x.astype(object) - centre
                total = total + d.T @ d
        return (total,) if some else None

    return partial


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs below n, in rounds of pairs that share no number."""
    ring = [*range(n), *([-1] if n % 2 else [])]
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if min(a, b) >= 0]
        if pairs:
            out.append(tuple(np.array(side) for side in zip(*pairs, strict=True)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a, n = np.array(matrix, float), len(matrix)
    vectors, rounds = np.eye(n), _rounds(n)
    least = np.finfo(float).tiny
    for _ in range(sweeps):
        turned = False
        for p, q in rounds:
            off = a[p, q]
            pick = np.abs(off) > np.maximum(np.finfo(float).eps * 0.5 * np.sqrt(np.abs(a[p, p] * a[q, q])), least)
            if not pick.any():
                continue
            turned = True
            p, q, off = p[pick], q[pick], off[pick]
            pp, qq = a[p, p], a[q, q]
            theta = (qq - pp) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for m, axis in ((a, 0), (a, 1), (vectors, 1)):
                at = (lambda i, axis=axis: (i, slice(None)) if axis == 0 else (slice(None), i))
                cc, ss = (c[:, None], s[:, None]) if axis == 0 else (c, s)
                x, y = m[at(p)], m[at(q)]
                m[at(p)], m[at(q)] = cc * x - ss * y, ss * x + cc * y
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = pp - t * off, qq + t * off
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    top = vectors[np.abs(vectors).argmax(0), np.arange(n)] if n else np.ones(0)
    return values[order], vectors * np.where(top < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """What whitening needs of the fit list: its size, sums, rounded mean, eigenvalues and whitening matrix."""

    n: int
    sums: list[int]
    centre: list[int]
    values: np.ndarray
    matrix: np.ndarray
    trace: float
    identity_error: float | None = None

    def rest(self) -> np.ndarray:
        """How far the mean lies from the rounded mean."""
        return np.array([(s - self.n * c) / self.n for s, c in zip(self.sums, self.centre, strict=True)])

    def apply(self, x: np.ndarray) -> np.ndarray:
        spread = np.abs(x.astype(float)).max(initial=0) + max(map(abs, self.centre))
        d = x - np.array(self.centre, np.int64) if spread < 1 << 62 else x.astype(object) - np.array(self.centre, object)
        return (d.astype(float) - self.rest()) @ self.matrix

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n * x - S)**2, exactly; null beyond 64 bits."""
        most = self.n * int(np.abs(x.astype(float)).max(initial=0) + 1) + max(map(abs, self.sums))
        if len(self.sums) * most * most < _LIMIT:
            return pa.array((((self.n * x) - np.array(self.sums, np.int64)) ** 2).sum(1), pa.int64())
        wide = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return pa.array([v if v < _LIMIT else None for v in wide], pa.int64())


def _measured(fitted: Whitening, dim: int):
    def partial(batches: Iterator[pa.RecordBatch]) -> tuple | None:
        n, total, square = 0, 0.0, 0.0
        for _, x in _matrices(batches, "x", dim):
            z = fitted.apply(x)
            n, total, square = n + len(z), total + z.sum(0), square + z.T @ z
        return (n, total, square) if n else None

    return partial


def fit(rows: DataFrame, components: int | None = None) -> Whitening | None:
    """The whitening of rows (x), which should be staged: passes for size, sums, scatter and the identity error.

    components: so many of the largest, all by default. None where there are no rows."""
    most = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if most is None:
        return None
    dim = most["d"]
    if dim > MAX_DIMENSION:
        raise ValueError(f"vectors of {dim} entries: the covariance is held whole up to {MAX_DIMENSION}")
    own = stage(rows.where(F.size("x") == dim).select("x").distinct(), "fit")
    n, sums = _folded(own, _sums(dim))
    centre = np.array([(2 * int(s) + n) // (2 * n) for s in sums], object)
    (scatter,) = _folded(own, _products(dim, centre))
    rest = [int(s) - n * int(c) for s, c in zip(sums, centre, strict=True)]
    cov = np.array([[(n * int(scatter[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    values, vectors = jacobi(cov)
    trace = float(np.trace(cov))
    kept_values, kept_vectors = values[:components], vectors[:, :components]
    sound = kept_values > max(trace, 0.0) * dim * np.finfo(float).eps
    matrix = kept_vectors[:, sound] / np.sqrt(kept_values[sound])
    fitted = Whitening(n, [int(s) for s in sums], [int(c) for c in centre], kept_values, matrix, trace)
    if sound.any():
        _, total, square = _folded(own, _measured(fitted, dim))
        mean = total / n
        # sums of doubles depend on their order in the last bits, so the error is given to 12 decimals
        fitted.identity_error = round(float(np.abs(square / n - np.outer(mean, mean) - np.eye(len(square))).max()), 12)
    return fitted


def whiten(table: DataFrame, components: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) for every row that takes part.

    whitened and explained are arrays with an entry for each component, the largest first."""
    schema = "vec_id bigint, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    base = scaled(table, id_col, vec_col, scale)
    with scratch(table.sparkSession):
        fitted = fit(base.select("x"), components)
    if fitted is None:
        return table.sparkSession.createDataFrame([], schema)
    dim, lost = len(fitted.sums), len(fitted.values) - fitted.matrix.shape[1]
    explained = [float(v / fitted.trace) if fitted.trace > 0 else None for v in fitted.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, "x", dim):
            rows = len(x)
            z = np.concatenate([fitted.apply(x), np.full((rows, lost), np.nan)], 1)
            ends = np.arange(rows + 1, dtype=np.int32) * z.shape[1]
            flat = pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel()))
            columns = [part.column(0), pa.array(np.full(rows, fitted.n), pa.int64()), fitted.deviations(x), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([explained] * rows, pa.list_(pa.float64())), pa.array([fitted.identity_error] * rows, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return base.where(F.size("x") == dim).mapInArrow(trimmed(run), schema)
