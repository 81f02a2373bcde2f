"""Embedding whitening with refined eigenvectors (operator 12).

Vectors become integers, equal ones count once, and the covariance is exact: tasks send integer sums of
products of the vectors less their rounded mean, the driver takes off what the rounding left. It holds
one dims x dims matrix, whatever the number of rows. Float32 eigenvectors start the refinement of
Ogita and Aishima: each step is a few matrix products in extended precision and squares the
error. Eigenvalues that lie closer than the step can tell apart form a cluster; its subspace is
known well, so a small eigenproblem of the matrix restricted to it, shifted by the cluster's mean,
separates them (their second paper).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import integers, lists, matrix, slices, whole

#: Fixed values of the contract: x = floor(SCALE * component) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
LIMIT = 1 << 30
EXACT = 1 << 53
HIGH = np.longdouble


def refine(a: np.ndarray, x: np.ndarray, most_steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of the symmetric ``a`` in extended precision, from approximate vectors ``x``."""
    a, x = a.astype(HIGH), x.astype(HIGH)
    one, size = np.eye(len(a), dtype=HIGH), np.abs(a).sum(axis=1).max()
    for step in range(most_steps):
        r, s = one - x.T @ x, x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(values)
        x, values, r, s = x[:, order], values[order], r[np.ix_(order, order)], s[np.ix_(order, order)]
        off = np.linalg.norm((s - np.diag(np.diag(s))).astype(float), 2) + float(size) * np.linalg.norm(r.astype(float), 2)
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > 2 * off
        # (s + value_j * r) / gap, with its antisymmetric part apart, so that rounding can't spoil orthogonality.
        middle = (values[None, :] + values[:, None]) / 2
        change = r / 2 + np.where(apart, (s + middle * r) / np.where(apart, gap, 1), 0)
        x = x + x @ change
        if np.abs(change).max() < np.finfo(HIGH).eps * 64:
            break
        ends = np.flatnonzero(np.append(np.diff(values) > 2 * off, True)) + 1
        for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            if end - start > 1 and step < most_steps - 1:
                own = x[:, start:end]
                inner = own.T @ a @ own - values[start:end].mean() * (own.T @ own)
                scale = np.abs(inner).max()
                if scale > 0:
                    x[:, start:end] = own @ np.linalg.eigh(((inner + inner.T) / (2 * scale)).astype(float))[1].astype(HIGH)
    for _ in range(2):  # what rounding turned within a close pair is no longer a change of the subspace; only orthogonality is mended
        x = x + x @ (one - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt(np.einsum("ij,ij->j", x, x))[order]
    return values[order], x * np.sign(x[np.abs(x).argmax(axis=0), range(len(a))])


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: ``rest`` is the sum of the fit list's x less ``middle``, so the mean is middle + rest / n."""

    dims: int
    n: int
    middle: np.ndarray
    rest: list[int]
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def projected(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([float(Fraction(r, self.n)) for r in self.rest])
        return (x - self.middle - mean) @ (self.axes / np.sqrt(self.values)).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S)^2, exactly; None where it doesn't fit a long."""
        z = x - self.middle
        largest = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, self.rest), default=0)
        exact = np.int64 if largest * largest * self.dims < 1 << 62 else object
        y = z.astype(exact) * self.n - np.array(self.rest, dtype=exact)
        return [int(s) if s < 1 << 63 else None for s in (y * y).sum(axis=1)]


def _products(z: np.ndarray) -> np.ndarray:
    """z'z in exact integers."""
    if len(z) * int(np.abs(z).max(initial=0)) ** 2 < EXACT:
        return (z.astype(float).T @ z.astype(float)).astype(np.int64).astype(object)
    return z.astype(object).T @ z.astype(object)


def _added(fit: DataFrame, of: Callable[[pa.Array], np.ndarray], width: int, parts: int = 64) -> list[int]:
    """Sums over all rows of ``of(x)``, ``width`` integers, added exactly: a row from each task, then one for each of ``parts`` sets of tasks."""

    def row(part: int, total: np.ndarray) -> pa.RecordBatch:
        packed = b"".join(int(t).to_bytes(24, "little", signed=True) for t in total)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["part", "v"])

    def unpacked(packed: bytes) -> np.ndarray:
        return np.array([int.from_bytes(packed[i : i + 24], "little", signed=True) for i in range(0, len(packed), 24)], dtype=object)

    def of_task(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(rows):
            part = of(batch.column("x")).astype(object)
            total = part if total is None else total + part
        if total is not None:
            yield row(TaskContext.get().partitionId() % parts, total)

    def of_part(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in rows:
            for packed in batch.column("v"):
                total = unpacked(packed.as_py()) if total is None else total + unpacked(packed.as_py())
        yield row(key[0].as_py(), total)

    schema = "part int, v binary"
    sums = fit.mapInArrow(of_task, schema).groupBy("part").applyInArrow(of_part, schema).collect()  # `parts` rows
    return sum((unpacked(r["v"]) for r in sums), np.zeros(width, dtype=object)).tolist()


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """vec_id, x of the vectors without null and non-finite entries that have the commonest length (the larger on a tie), and that length."""
    narrow = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    length = narrow.filter("size(vector) > 0").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = length["d"] if length else 0

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows):
            at, values = whole(batch.column(1), dims)
            x = integers(values, SCALE, LIMIT) + OFFSET
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists(x, pa.int32())], names=["vec_id", "x"])

    kind = narrow.schema["vec_id"].dataType.simpleString()
    return narrow.filter(F.size("vector") == dims).mapInArrow(run, f"vec_id {kind}, x array<int>"), dims


def fit_whitening(fit: DataFrame, dims: int, components: int = 16) -> Whitening | None:
    """The transform of the distinct vectors ``fit`` (column x); None without any, or if all are equal.

    Components are eigenvectors of the covariance with divisor n, by falling eigenvalue; those whose eigenvalue
    is zero to double precision have no whitened values and are left out. The entry of largest size is positive.
    """
    n = fit.count()
    if not n:
        return None
    total = _added(fit, lambda x: matrix(x, dims).sum(axis=0), dims)
    middle = np.array([(2 * t + n) // (2 * n) for t in total])
    rest = [t - n * int(m) for t, m in zip(total, middle, strict=True)]
    i, j = np.triu_indices(dims)
    upper = _added(fit, lambda x: _products(matrix(x, dims) - middle)[i, j], len(i))
    covariance = np.zeros((dims, dims), dtype=HIGH)
    trace = Fraction(0)
    for a, b, m in zip(i.tolist(), j.tolist(), upper, strict=True):
        exact = Fraction(n * m - rest[a] * rest[b], n * n)
        near = float(exact)
        covariance[a, b] = covariance[b, a] = HIGH(near) + HIGH(float(exact - Fraction(near)))
        trace += exact if a == b else 0
    if not trace:
        return None
    values, axes = refine(covariance, np.linalg.eigh(covariance.astype(np.float32))[1])
    kept = min(components, int((values > values[0] * dims * np.finfo(float).eps).sum()))
    values, axes = values[:kept], axes[:, :kept]
    return Whitening(dims, n, middle, rest, values, axes, (values / HIGH(float(trace))).astype(float))


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance less the identity; a batch's sums are rounded at 2^-40, so their order is no matter."""
    width, unit = len(model.values), float(1 << 40)

    def moments(x: pa.Array) -> np.ndarray:
        w = model.projected(matrix(x, model.dims))
        return np.array([int(v) for v in np.rint(np.vstack([w.T @ w, w.sum(axis=0)]).reshape(-1) * unit)], dtype=object)

    total = np.array([t / unit / model.n for t in _added(fit, moments, width * (width + 1))]).reshape(width + 1, width)
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(width)).max())


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, whitened (array), explained (array), identity_error of each kept row.

    Kept are rows whose vector has no null or non-finite entry and the commonest length of the table; a
    component of 2^24 or more in size is an error. Equal vectors count once in the fit and are whitened row by row; a null id
    is kept. An empty table, or one whose vectors are all equal, gives no rows. ``deviation`` is null
    where it doesn't fit a long. Other columns are not read, whatever their names.
    """
    rows, dims = integer_vectors(vectors, id_col, vector_col)
    fit = cut(rows.select("x").distinct())
    model = fit_whitening(fit, dims, components)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = _identity_error(fit, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = matrix(batch.column("x"), dims)
            n, explained = len(x), np.tile(model.explained, (len(x), 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([model.n] * n, pa.int64()), pa.array(model.deviations(x), pa.int64()), lists(model.projected(x), pa.float64()), lists(explained, pa.float64()), pa.array([error] * n, pa.float64())],
                names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def whitening_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each kept row and component; see ``whiten``."""
    both = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of")
    rows = whiten(vectors, **options).select("vec_id", "n", "deviation", "identity_error", both)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error")
