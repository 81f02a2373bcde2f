"""Exact centroid clustering over a VA-file (operator 11).

Every vector is kept twice: as integers, and as one cell of 2^bits in each dimension. In a round,
lookup tables give for each (dimension, cell, centroid) the least and the largest part of the
distance, so 2 x dims table rows are added for a vector and give an interval for each centroid. The
vector's own square is the same for all centroids and left out, and the dimension's mean is taken off
first: both make the intervals narrower. Only where intervals overlap are the vector's integers
fetched and the exact distances to those centroids computed, so clusters are those of a full search.

The update needs exact sums, hence every vector: a row for each (cluster, dimension) and task.
Nothing but centroids, cell bounds and sums (k x dims numbers each) is ever on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from hashlib import sha256
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import integers, lists, matrix, slices, whole

#: 64 squared differences of two numbers below this limit fit a long, as does a billion of them.
LIMIT = 1 << 27


@dataclass(frozen=True)
class Cells:
    """Bounds of the cells: cell j of dimension i holds the integers lo[i, j] to hi[i, j]."""

    middle: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @classmethod
    def fitted(cls, n: int, low: np.ndarray, high: np.ndarray, total: np.ndarray, squares: np.ndarray, bits: int) -> Cells:
        """Cells that hold equally many numbers of a normal distribution; the outer two reach to the data's ends."""
        mean = total / n
        deviation = np.sqrt(np.maximum(squares / n - mean * mean, 0))
        cuts = np.array([NormalDist().inv_cdf(i / 2**bits) for i in range(1, 2**bits)])
        edges = np.ceil(mean[:, None] + deviation[:, None] * cuts).astype(np.int64)
        edges = np.clip(edges, low[:, None], high[:, None] + 1)
        return cls(np.rint(mean).astype(np.int64), np.column_stack([low, edges]), np.column_stack([edges - 1, high]))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(self.lo[i, 1:], x[:, i], side="right") for i in range(x.shape[1])]).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """(dimension, cell, 2k): least and largest c*c - 2*x*c over the cell, c and x less the middle."""
        c = (centroids - self.middle).T[:, None, :]
        ends = [c * c - 2 * (bound - self.middle[:, None])[:, :, None] * c for bound in (self.lo, self.hi)]
        return np.concatenate([np.minimum(*ends), np.maximum(*ends)], axis=2)


@dataclass(frozen=True)
class Clusters:
    """Centroids as integer rows, and the cells of the vectors they were fitted to."""

    cells: Cells
    centroids: np.ndarray

    def nearest(self, codes: np.ndarray, x: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, int]:
        """Number of the nearest centroid of each vector, the smaller one on a tie; how many distances were computed."""
        k = len(self.centroids)
        bounds = tables[0][codes[:, 0]]
        for i in range(1, codes.shape[1]):
            bounds += tables[i][codes[:, i]]
        open_ = bounds[:, :k] <= bounds[:, k:].min(axis=1)[:, None]
        found = open_.argmax(axis=1)
        several = np.flatnonzero(open_.sum(axis=1) > 1)
        row, centroid = np.nonzero(open_[several])
        exact = np.full((len(several), k), np.iinfo(np.int64).max)
        exact[row, centroid] = ((x[several[row]] - self.centroids[centroid]) ** 2).sum(axis=1)
        found[several] = exact.argmin(axis=1)
        return found, len(row)


def _coded(vectors: DataFrame, dims: int, scale: int, bits: int) -> tuple[DataFrame, Cells | None]:
    """vec_id, x, codes of the kept vectors, written once, and the cells; None without vectors."""

    def moments(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, total, squares, n = np.full(dims, LIMIT), np.full(dims, -LIMIT), np.zeros(dims), np.zeros(dims), 0
        for batch in slices(rows):
            x = integers(whole(batch.column(0), dims)[1], scale, LIMIT)
            if len(x):
                low, high, n = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)), n + len(x)
                total, squares = total + x.sum(axis=0), squares + (x.astype(float) ** 2).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims)), pa.array([n] * dims), *map(pa.array, (low, high, total, squares))], names=["dim", "n", "low", "high", "total", "squares"])

    parts = vectors.select("vector").mapInArrow(moments, "dim bigint, n bigint, low bigint, high bigint, total double, squares double")
    by_dim = parts.groupBy("dim").agg(F.sum("n"), F.min("low"), F.max("high"), F.sum("total"), F.sum("squares")).orderBy("dim").collect()  # a row for each dimension
    cells = None
    if by_dim:
        _, n, low, high, total, squares = (np.array(c) for c in zip(*by_dim, strict=True))
        cells = Cells.fitted(int(n[0]), low, high, total, squares, bits)

    def encode(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows):
            at, values = whole(batch.column(1), dims)
            x = integers(values, scale, LIMIT)
            codes = cells.codes(x) if cells else np.empty((0, dims), dtype=np.uint8)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists(x, pa.int32()), packed], names=["vec_id", "x", "codes"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return cut(vectors.mapInArrow(encode, f"vec_id {kind}, x array<int>, codes binary")), cells


def _over(clusters: Clusters, dims: int, emit: Callable) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over coded rows that hands ``emit`` each batch with its integers and clusters."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = clusters.cells.tables(clusters.centroids)

        def parts() -> Iterator[tuple]:
            for batch in slices(rows):
                x = matrix(batch.column("x"), dims)
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, dims)
                yield batch, x, clusters.nearest(codes, x, tables)[0]

        yield from emit(parts())

    return run


def _sums(parts: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """One row for each (cluster, dimension) of a task."""
    total: dict[int, list] = {}
    for _, x, found in parts:
        for k in np.unique(found).tolist():
            own = x[found == k]
            n, s = total.get(k, (0, 0))
            total[k] = [n + len(own), s + own.sum(axis=0)]
    for k, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(s)), pa.array(range(len(s))), pa.array([n] * len(s)), pa.array(s)], names=["cluster", "dim", "n", "total"])


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, bits: int = 6, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, Clusters | None]:
    """(vec_id, cluster, distance by row; the centroids) after ``rounds`` of assignment and update.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; x is floor(scale * component),
    and a component too large for exact sums is an error. The first centroids are the k kept vectors
    with the smallest sha256 of "seed:id", a null id being empty text, ties by components; with fewer
    than k vectors there are fewer clusters. Repeated rows are clustered one by one, ties of distance go to
    the smaller number, an empty cluster keeps its centroid, an empty table gives no rows and no
    clusters. Other columns are not read, whatever their names.
    """
    narrow = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    coded, cells = _coded(narrow, dims, scale, bits)
    kind = coded.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance bigint"
    if cells is None:
        return coded.sparkSession.createDataFrame([], schema), None
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = coded.select(named.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    clusters = Clusters(cells, np.array([r["x"] for r in first], dtype=np.int64))
    for _ in range(rounds):
        sums = coded.mapInArrow(_over(clusters, dims, _sums), "cluster bigint, dim bigint, n bigint, total bigint")
        centroids = clusters.centroids.copy()
        for r in sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # k x dims rows
            centroids[r["cluster"], r["dim"]] = r["total"] // r["n"]
        clusters = replace(clusters, centroids=centroids)

    def assigned(parts: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        for batch, x, found in parts:
            distance = ((x - clusters.centroids[found]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return coded.mapInArrow(_over(clusters, dims, assigned), schema), clusters


def clustering_report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 by kept row; see ``cluster_vectors``."""
    rows, clusters = cluster_vectors(vectors, **options)
    rows = cut(rows)
    found = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    named = [(c, d, sum(found.values()), sha256(",".join(map(str, clusters.centroids[c].tolist())).encode()).hexdigest()) for c, d in found.items()]
    totals = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows


def clustering_sql(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    """The report in DuckDB SQL over the table `embeddings`: every distance of every round."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims})""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS k, x
  FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM kept ORDER BY h, x LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, min(k) AS k, min(d) AS d FROM (SELECT *, min(d) OVER (PARTITION BY r) AS least FROM (SELECT v.r, c.k, {distance} AS d FROM kept v, c{i} c)) WHERE d = least GROUP BY r)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT k, list(x ORDER BY j) AS x FROM (
      SELECT k, j, (sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM (SELECT a.k, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS j FROM a{i} a JOIN kept v USING (r)) GROUP BY k, j)
    GROUP BY k) n ON c.k = n.k)"""
            )
    return f"""
WITH {", ".join(steps)}
SELECT v.vec_id, a.k AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.x, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept v USING (r) JOIN c{rounds} c ON c.k = a.k
"""
