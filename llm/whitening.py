"""Whitening of embeddings by their leading principal components.

Each entry c becomes the whole number floor(64 c) + 1000000. Every distinct vector of such numbers counts once in the fit: sums per dimension,
then products of centred vectors, are added up per task and per cell of the matrix in Spark. The driver holds one matrix of dimensions
squared: it brings it to tridiagonal form by Householder reflections, finds the leading eigenvalues by bisection on Sturm counts and
their vectors by inverse iteration, orthogonal within clusters. The projection, dimensions by components, is broadcast.

Nulls: a row whose vector is null, or holds a null, a non-finite entry or one whose 64-fold passes 2 ** 62, is dropped; so is a vector of another length than most
distinct vectors have (ties: the longer), and an empty one. Null ids are carried, repeated rows each get their rows. Equal eigenvalues: some orthonormal
basis of their space. A component without variance (rank too low) has ``whitened`` null and is left out of ``identity_error``; without any variance
``explained`` is null too. A deviation over 38 digits is null. An empty table gives no rows. Only the id and vector columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.common import stored

SCALE, SHIFT = 64, 1_000_000
_SAFE = 1 << 62
_ROWS = 2048


def _whole(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(64 c) by row and dimension) of a column's valid vectors, by length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dims)
        values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dims)
        with np.errstate(invalid="ignore", over="ignore"):
            values = np.floor(values * SCALE)
            fits = (np.abs(values) < _SAFE).all(axis=1)
        if fits.any():
            yield rows[fits], values[fits].astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """One key per vector: the width of its numbers, then the numbers; equal vectors have equal keys."""
    largest = np.abs(x).max(axis=1)
    widths = np.select([largest < 1 << 7, largest < 1 << 15, largest < 1 << 31], [1, 2, 4], 8)
    out = [b""] * len(x)
    for width in np.unique(widths):
        for row in np.flatnonzero(widths == width):
            out[row] = bytes([width]) + x[row].astype(f"<i{width}").tobytes()
    return out


def _unpacked(keys: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(keys), dims), np.int64)
    for row, key in enumerate(keys):
        out[row] = np.frombuffer(key, f"<i{key[0]}", offset=1)
    return out


def _keys(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, x in _whole(batch.column("vector")):
                yield pa.RecordBatch.from_arrays([pa.array(_packed(x), pa.binary()), pa.array(np.full(len(x), x.shape[1], np.int32))], names=["key", "dims"])

    return rows.mapInArrow(run, "key binary, dims int")


def _matrices(batches, dims: int) -> Iterator[np.ndarray]:
    """The fit list's vectors, a bounded number of rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            yield _unpacked(batch.column("key").slice(start, _ROWS).to_pylist(), dims)


def _totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of floor(64 c) per dimension."""

    def run(batches):
        n, total = 0, np.zeros(dims, object)
        for x in _matrices(batches, dims):
            exact = x.sum(axis=0) if np.abs(x).max() < _SAFE // _ROWS else x.astype(object).sum(axis=0)
            n, total = n + len(x), total + exact.astype(object)
        if n:
            sums = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), sums], names=["i", "n", "s"])

    found = fit.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    return found[0]["n"], [int(r["s"]) for r in sorted(found, key=lambda r: r["i"])]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where it surely fits, else in whole numbers of any size."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    return x * n - np.array(sums, np.int64) if bound < _SAFE else x.astype(object) * n - np.array(sums, object)


def _covariance(fit: DataFrame, n: int, sums: list[int], project: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the fit list's vectors, centred before multiplying, or of their projections."""
    dims, size = len(sums), len(sums) if project is None else project.shape[1]
    upper = np.triu_indices(size)

    def run(batches):
        total, any_rows = np.zeros((size, size)), False
        for x in _matrices(batches, dims):
            y = _centred(x, n, sums).astype(np.float64) / n
            y = y if project is None else y @ project
            total += y.T @ y
            any_rows = True
        if any_rows:
            columns = [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "v"])

    out = np.zeros((size, size))
    for r in fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflection vectors of a symmetric matrix's Householder reduction."""
    a, n = np.array(matrix, float), len(matrix)
    reflections = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if np.any(v[1:]):
            alpha = -np.copysign(norm, v[0])
            v[0] -= alpha
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = alpha
        else:
            v[:] = 0
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each point."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float(np.max(off * off, initial=0)))
    q = diagonal[0] - at
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        q = d - at - e * e / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection to the last bit."""
    n = len(diagonal)
    radius = np.concatenate([np.abs(off), [0]]) + np.concatenate([[0], np.abs(off)])
    low, high = np.full(k, (diagonal - radius).min()), np.full(k, (diagonal + radius).max())
    pad = np.finfo(float).eps * n * max(np.abs(low).max(), np.abs(high).max(), np.finfo(float).tiny)
    low, high = low - pad, high + pad
    wanted = n - 1 - np.arange(k)  # at most so many eigenvalues are below the sought one
    while True:
        mid = low + (high - low) / 2
        if np.all((mid <= low) | (mid >= high)):
            return mid
        below = sturm_counts(diagonal, off, mid) <= wanted
        low, high = np.where(below, mid, low), np.where(below, high, mid)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Solution of (T - shift) y = right by elimination with row exchanges; zero pivots become tiny."""
    n = len(diagonal)
    eps = np.finfo(float).eps * max(1.0, np.abs(diagonal).max(), np.abs(off).max(initial=0))
    rows = np.zeros((n, 3))
    rows[:, 0], rows[:-1, 1] = diagonal - shift, off
    y = right.copy()
    for i in range(n - 1):
        below = np.array([off[i], rows[i + 1, 0], rows[i + 1, 1]])
        if abs(below[0]) > abs(rows[i, 0]):
            rows[i], below = below, rows[i].copy()
            y[i], y[i + 1] = y[i + 1], y[i]
        if rows[i, 0] == 0:
            rows[i, 0] = eps
        m = below[0] / rows[i, 0]
        rows[i + 1] = [below[1] - m * rows[i, 1], below[2] - m * rows[i, 2], 0]
        y[i + 1] -= m * y[i]
    for i in range(n - 1, -1, -1):
        for j in (1, 2):
            if i + j < n:
                y[i] -= rows[i, j] * y[i + j]
        y[i] /= rows[i, 0] if abs(rows[i, 0]) > eps else np.copysign(eps, rows[i, 0])
        if abs(y[i]) > 1e200:
            y /= 1e200
    return y


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, of a matrix of entries about 1, by inverse iteration; vectors of a cluster are made orthogonal to those before."""
    n, rng = len(diagonal), np.random.default_rng(0)
    scale = max(1.0, np.abs(diagonal).max(), np.abs(off).max(initial=0))
    out = np.zeros((n, len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * scale:
            first = k
        shift = value - (k - first) * 4 * np.finfo(float).eps * scale  # equal values get shifts of their own
        y = rng.standard_normal(n)
        for _ in range(6):
            y = _solved(diagonal, off, shift, y / np.linalg.norm(y))
            for _ in range(2):
                y -= out[:, first:k] @ (out[:, first:k].T @ y)
                norm = np.linalg.norm(y)
                y = y / norm if norm > 0 else rng.standard_normal(n)
        out[:, k] = y / np.linalg.norm(y)
    return out


def principal(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = float(np.abs(matrix).max(initial=0)) or 1.0
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, k)
    vectors = eigenvectors(diagonal, off, values)
    for i, v in reversed(list(enumerate(reflections))):
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    return values * scale, vectors


@dataclass(frozen=True)
class Whitening:
    """A fit: number of distinct vectors, sums of floor(64 c), eigenvalues, the projection that whitens, the trace, the measured error."""

    n: int
    sums: list[int]
    values: np.ndarray
    project: np.ndarray
    rank: int
    trace: float
    identity_error: float | None


def fit(vectors: DataFrame, components: int = 16, vec_col: str = "embedding") -> Whitening | None:
    """Fit on the distinct vectors of a table; None if it has no valid one."""
    listed = stored(_keys(vectors.select(F.col(vec_col).alias("vector"))).distinct(), "whiten-fit")
    lengths = listed.groupBy("dims").count().collect()  # one row per length of vector
    if not lengths:
        return None
    dims = max((r["count"], r["dims"]) for r in lengths)[1]
    listed = listed.where(F.col("dims") == dims).select("key")
    n, sums = _totals(listed, dims)
    matrix = _covariance(listed, n, sums)
    k = min(components, dims)
    values, basis = principal(matrix, k)
    rank = int((values > dims * np.finfo(float).eps * max(values[0], 0)).sum())
    project = basis[:, :rank] / np.sqrt(values[:rank])
    error = float(np.abs(_covariance(listed, n, sums, project) - np.eye(rank)).max()) if rank else None
    return Whitening(n, sums, values, project, rank, float(np.trace(matrix)), error)


def transform(vectors: DataFrame, fitted: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened array) of each valid row; whitened has one entry per component with variance."""
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        w = shared.value
        for batch in batches:
            for rows, x in _whole(batch.column("vector")):
                for start in range(0, len(x) if x.shape[1] == len(w.sums) else 0, _ROWS):
                    centred = _centred(x[start : start + _ROWS], w.n, w.sums)
                    y = (centred.astype(np.float64) / w.n) @ w.project
                    largest = int(np.abs(centred).max(initial=0))
                    if largest**2 * len(w.sums) >= _SAFE:
                        squares = (centred.astype(object) ** 2).sum(axis=1)
                        deviation = pa.array([Decimal(int(s)) if s < 10**38 else None for s in squares], pa.decimal128(38, 0))
                    else:
                        deviation = pa.array((centred * centred).sum(axis=1)).cast(pa.decimal128(38, 0))
                    offsets = np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]
                    ids = batch.column("vec_id").take(pa.array(rows[start : start + _ROWS]))
                    yield pa.RecordBatch.from_arrays([ids, deviation, pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))], names=["vec_id", "deviation", "whitened"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vector"))
    return rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whitened(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row per valid row and component."""
    fitted = fit(vectors, components, vec_col)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    share = [float(e / fitted.trace) if fitted.trace > 0 else None for e in fitted.values]
    part = F.explode(F.sequence(F.lit(1), F.lit(len(share))))
    found = transform(vectors, fitted, id_col, vec_col).select("vec_id", part.alias("component"), "deviation", "whitened")
    return found.select(
        "vec_id",
        "component",
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        F.get("whitened", F.col("component") - 1).alias("whitened"),
        F.get(F.array(*(F.lit(s).cast("double") for s in share)), F.col("component") - 1).alias("explained"),
        F.lit(fitted.identity_error).cast("double").alias("identity_error"),
    )
