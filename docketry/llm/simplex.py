"""Centroid clustering of whole-number vectors, filtered by an n-simplex projection.

A vector's distances to several pivots are taken once and kept beside it. With
them every vector becomes the apex of a simplex over the pivots: coordinates of
as many dimensions as there are pivots, the last one an altitude of 0 or more.
The Euclidean distance of two apexes is at most the distance of the vectors, and
with the altitudes on opposite sides it is at least that. In each round a
centroid whose lower bound exceeds another one's upper bound, or the exact distance
of the one that looks nearest, is no candidate of a vector; the candidates left are
compared by exact squared distances of whole numbers.

Vectors with exactly ``width`` components, none null or not finite, take part;
each component x becomes floor(``scale`` * x). A number beyond 2^27 in size
counts as 2^27, so that squared distances fit a long. Starting centroids are the
vectors with the smallest sha256 of ``1:<id>``; a null id counts as empty text,
and rows of one id are told apart by their numbers. With fewer vectors than centroids
every vector is a centroid. Ties go to the smaller centroid number. Repeated
rows count as often as they are there. Without any vector the result is empty. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .vectors import batches_of, finite_rows, narrow, packed, unpacked, whole_numbers

LIMIT = 1 << 27


@dataclass
class Simplex:
    """Pivots and the corner coordinates of the simplex that they span."""
    pivots: np.ndarray
    corners: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray) -> Simplex:
        """Corners from distances alone; a pivot inside the span of those before is left out."""
        chosen, corners = [], np.zeros((0, 0))
        for point in points:
            if not chosen:
                chosen, corners = [point], np.zeros((1, 0))
                continue
            base = cls(np.array(chosen), corners)
            apex = base.apexes(base.squared(point[None]))[0]
            if apex[-1] > 1e-3 * max(1.0, np.abs(apex).max()):
                n = len(chosen)
                chosen.append(point)
                corners = np.vstack([np.hstack([corners, np.zeros((n, 1))]), apex])
        return cls(np.array(chosen), corners)

    def squared(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances to the pivots."""
        return np.stack([squares(x - p) for p in self.pivots], axis=1)

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """Apex coordinates of points with these squared distances to the pivots."""
        d = squared.astype(float)
        n = len(self.pivots)
        out = np.zeros((len(d), n))
        left = d[:, 0].copy()
        for i in range(1, n):
            # Corner i has i coordinates; the last is its altitude over the corners before.
            corner = self.corners[i]
            norm = float(corner[:i] @ corner[:i])
            part = out[:, :i - 1] @ corner[:i - 1]
            out[:, i - 1] = ((d[:, 0] - d[:, i] + norm) / 2 - part) / corner[i - 1]
            left -= out[:, i - 1] ** 2
        out[:, n - 1] = np.sqrt(np.maximum(0, left))
        return out


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds between apexes of two tables."""
    flat = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    return (flat + (a[:, None, -1] - b[None, :, -1]) ** 2,
            flat + (a[:, None, -1] + b[None, :, -1]) ** 2)


def nearest(x: np.ndarray, squared: np.ndarray, centroids: np.ndarray,
            simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid number, exact squared distance, pairs compared) of rows and their pivot distances."""
    lower, upper = bounds(simplex.apexes(squared), simplex.apexes(simplex.squared(centroids)))
    # Coordinates are as exact as doubles of this size; bounds are widened by far more.
    reach = 1 + float(squared.max(initial=0)) + float(simplex.squared(centroids).max(initial=0))
    slack = 0.5 + 1e-6 * reach
    # The centroid that looks nearest sets a bar at least as good as its upper bound.
    likely = lower.argmin(axis=1)
    reached = squares(x - centroids[likely])
    bar = np.minimum(upper.min(axis=1), reached) + slack
    lower[np.arange(len(x)), likely] = np.inf
    row, number = np.nonzero(lower <= bar[:, None])
    compared = len(x) + len(row)
    row, number = np.append(np.arange(len(x)), row), np.append(likely, number)
    exact = np.append(reached, squares(x[row[len(x):]] - centroids[number[len(x):]]))
    order = np.lexsort((number, exact, row))
    first = order[np.diff(row[order], prepend=-1) > 0]
    return number[first], exact[first], compared


def cached(df: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """(id, x): the vectors that take part, packed."""
    bounded_batches(df.sparkSession)
    rows = narrow(df, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at, matrix in finite_rows(batch.column(1)):
                if matrix.shape[1] == width:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)),
                         pa.array(packed(whole_numbers(matrix, scale, LIMIT)), pa.binary())],
                        names=["id", "x"])

    return rows.mapInArrow(run, f"id {kind}, x binary")


def starts(rows: DataFrame, k: int, width: int) -> np.ndarray:
    """The ``k`` vectors whose id has the smallest sha256 after ``1:``."""
    name = F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    found = rows.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(k).toArrow()
    return unpacked(found.column("x").combine_chunks(), width)


def with_distances(rows: DataFrame, simplex: Simplex, width: int) -> DataFrame:
    """(id, x, d): the squared distances to the pivots are taken once and kept."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for x, part in _pieces(batch, width):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(packed(simplex.squared(x)), pa.binary())],
                    names=["id", "x", "d"])

    return rows.mapInArrow(run, f"id {kind}, x binary, d binary")


def _pieces(batch: pa.RecordBatch, width: int):
    at = 0
    for x in batches_of(batch.column(1), width):
        yield x, batch.slice(at, len(x))
        at += len(x)


def next_centroids(rows: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """Componentwise floor of the mean of each centroid's vectors; empty ones stay.

    A task sends at most a row for each centroid and component, whatever its size.
    """
    width = centroids.shape[1]

    def run(batches):
        sums = np.zeros((len(centroids), width + 1), np.int64)
        for batch in batches:
            for x, part in _pieces(batch, width):
                number, _, _ = nearest(x, unpacked(part.column(2), len(simplex.pivots)), centroids,
                                       simplex)
                np.add.at(sums, (number, width), 1)
                for c in np.unique(number):
                    sums[c, :width] += x[number == c].sum(axis=0)
        cluster, place = np.flatnonzero(sums[:, width]), np.arange(width + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(cluster, width + 1).astype(np.int32)),
             pa.array(np.tile(place, len(cluster)).astype(np.int32)),
             pa.array(sums[cluster].ravel())], names=["cluster", "place", "total"])

    found = rows.mapInArrow(run, "cluster int, place int, total long").groupBy(
        "cluster", "place").agg(F.sum("total").alias("total")).collect()
    sums = {(r["cluster"], r["place"]): r["total"] for r in found}
    return np.array([[sums[c, i] // sums[c, width] for i in range(width)]
                     if (c, width) in sums else centroid
                     for c, centroid in enumerate(centroids.tolist())], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, id_col: str = "vec_id",
            vector_col: str = "embedding", width: int = 64, scale: int = 64) -> DataFrame:
    """Each vector's cluster after ``rounds`` rounds: ``id_col``, cluster, distance (squared),
    cluster_inertia, inertia, centroid_sha256, and compared, the exact comparisons it took."""
    spark = vectors.sparkSession
    rows = written(cached(vectors, id_col, vector_col, width, scale), "whole")
    centroids = starts(rows, k, width)
    kind = rows.schema["id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, "
                                     "cluster_inertia long, inertia long, centroid_sha256 string, "
                                     "compared double")
    simplex = Simplex.over(centroids)
    rows = written(with_distances(rows, simplex, width), "pivots")
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids, simplex)

    def run(batches):
        for batch in batches:
            for x, part in _pieces(batch, width):
                number, exact, compared = nearest(
                    x, unpacked(part.column(2), len(simplex.pivots)), centroids, simplex)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(number.astype(np.int32)), pa.array(exact),
                     pa.array(np.full(len(x), compared / len(x)))],
                    names=["id", "cluster", "distance", "compared"])

    placed = written(rows.mapInArrow(
        run, f"id {kind}, cluster int, distance long, compared double"), "clusters")
    inertia = placed.groupBy("cluster").agg(
        F.try_sum("distance").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in inertia) if all(
        r["cluster_inertia"] is not None for r in inertia) else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
               for c in centroids.tolist()]
    # At most k rows.
    sums = spark.createDataFrame(
        [(r["cluster"], r["cluster_inertia"],
          total if total is not None and total < 1 << 63 else None, digests[r["cluster"]])
         for r in inertia],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(sums), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia",
        "centroid_sha256", "compared")
