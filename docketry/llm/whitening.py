"""Whitening of vectors on the leading principal components, refined in mixed precision.

Numbers x = floor(``scale`` * c) + ``offset`` are whole, so Spark sums them, and
the products of their deviations, exactly: rows are centred at the whole number
nearest to each mean before they are multiplied, and the rest of the mean is
taken off in whole numbers too. Eigenvectors of that covariance are found in
float32 and corrected by Ogita-Aishima iterations, matrix products in extended
precision, until they are right to double precision. Eigenvalues too close for
the correction are told apart by a solve of their own within the space that
they span, shifted to its centre.

The fit takes every distinct x once. Rows whose vector is null or holds a null
or non-finite number are left out, and so are rows of another width than the
commonest (ties: the smaller width). A number beyond 2^46 in size after scaling
counts as 2^46. Repeated rows and null ids each keep their rows in the result.
Components whose eigenvalue is zero to rounding have no whitened value and are
left out, so one distinct vector, or an empty table, gives no rows. ``deviation`` is null where
it does not fit a long. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .vectors import ROWS_AT_ONCE, batches_of, finite_rows, narrow, packed, whole_numbers

LIMIT = 1 << 46
# Products of two parts of this many bits, summed over a block, stay exact in a double.
PART_BITS = 20
_CELLS = "i int, j int, value decimal(38,0)"
_CELLS_ARROW = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.decimal128(38, 0))])


@dataclass
class Whitening:
    """What whitening needs of the fit list. ``vectors`` are unit columns, eigenvalues fall."""
    width: int
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    scale: int
    offset: int

    @property
    def centre(self) -> list[int]:
        """The whole number nearest to each mean."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """n times what the means have beyond the centre."""
        return [s - self.n * c for s, c in zip(self.sums, self.centre)]

    def projected(self, centred: np.ndarray) -> np.ndarray:
        """Whitened rows of x less the centre."""
        rest = np.array([r / self.n for r in self.rest])
        return (centred - rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - S)^2 of rows of x less the centre."""
        rest = self.rest
        most = self.n * int(np.abs(centred).max(initial=0)) + max(map(abs, rest), default=0)
        if self.width * most * most < 1 << 63:
            away = self.n * centred - np.array(rest, np.int64)
            return np.einsum("ij,ij->i", away, away).tolist()
        found = [sum((self.n * c - r) ** 2 for c, r in zip(row, rest)) for row in centred.tolist()]
        return [v if v < 1 << 63 else None for v in found]


def exact_gram(x: np.ndarray) -> np.ndarray:
    """Sums of products of the columns of a block of longs, as Python numbers of any size."""
    parts, left = [], x
    while True:
        if np.abs(left).max(initial=0) < 1 << PART_BITS:
            parts.append(left.astype(float))
            break
        parts.append((left & ((1 << PART_BITS) - 1)).astype(float))
        left = left >> PART_BITS
    total = np.zeros((x.shape[1],) * 2, object)
    for a, left_part in enumerate(parts):
        for b, right_part in enumerate(parts):
            product = (left_part.T @ right_part).astype(np.int64).astype(object)
            total += product * (1 << PART_BITS * (a + b))
    return total


def _exact_cells(rows: DataFrame, width: int, centre: list[int] | None) -> dict[tuple[int, int], int]:
    """Sums of all columns (j = -1), or of the products of columns less ``centre`` (i <= j).

    A task sends a row for each sum, and Spark adds them up: as many rows reach
    the driver as the covariance has numbers.
    """
    def run(batches):
        total = np.zeros((width, width) if centre else width, object)
        for batch in batches:
            for x in batches_of(batch.column(0), width):
                if centre is None:
                    total += x.sum(axis=0).astype(object)
                else:
                    total += exact_gram(x - np.array(centre, np.int64))
        i, j = np.triu_indices(width) if centre else (np.arange(width), np.full(width, -1))
        values = total[i, j] if centre else total
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
             pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))],
            schema=_CELLS_ARROW)

    found = rows.select("x").mapInArrow(run, _CELLS).groupBy("i", "j").agg(
        F.sum("value").alias("value")).collect()
    return {(r["i"], r["j"]): int(r["value"]) for r in found}


def extended(numerator: int, divisor: int) -> np.longdouble:
    """A quotient of whole numbers beyond double precision."""
    quotient, rest = divmod(numerator, divisor)
    high = float(quotient)
    return np.longdouble(high) + np.longdouble(float(quotient - int(high))) + (
        np.longdouble(rest / divisor))


def refine(matrix: np.ndarray, vectors: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and orthonormal eigenvectors of a symmetric matrix, from approximate ones.

    Each round corrects X to X + X E. With R = I - X'X and S = X'AX, the entry
    E_ij is (S_ij + l_j R_ij) / (l_j - l_i), and R_ij / 2 for eigenvalues no
    farther apart than the error of S. Groups of those get a solve of their own.
    """
    a = matrix.astype(np.longdouble)
    x = vectors.astype(np.longdouble)
    n = len(a)
    unit = np.eye(n, dtype=np.longdouble)
    size = float(np.abs(a).sum(axis=1).max(initial=0)) or 1.0
    last = np.inf
    for _ in range(rounds):
        r = unit - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2       # rounding must not pull a pair of corrections apart
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        apart = 2 * float(np.linalg.norm(off.astype(float), 2)
                          + size * np.linalg.norm(r.astype(float), 2))
        gap = values[None, :] - values[:, None]
        # Below this, two eigenvalues cannot be told apart in extended precision either.
        apart = max(apart, 8 * n * size * float(np.finfo(np.longdouble).eps))
        far = np.abs(gap) > apart
        e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ e
        change = float(np.abs(e).max(initial=0))
        order = np.argsort(-values.astype(float), kind="stable")
        x, values = x[:, order], values[order]
        if change < 1e-17 or change >= last and change < 1e-15:
            break
        last = change
        for lo, hi in clusters(values, apart):
            x[:, lo:hi] = _sub_solve(a, x[:, lo:hi])
    x = x @ (3 * unit - x.T @ x) / 2
    values = ((a @ x) * x).sum(axis=0)
    return values, x


def clusters(values: np.ndarray, apart: float) -> list[tuple[int, int]]:
    """(start, stop) of the runs of falling values with gaps of at most ``apart``, two or more."""
    edges = [0, *(np.flatnonzero(values[:-1] - values[1:] > apart) + 1).tolist(), len(values)]
    return [(lo, hi) for lo, hi in zip(edges, edges[1:]) if hi - lo > 1]


def _sub_solve(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Turn a basis of a cluster's space to its eigenvectors: small, shifted, scaled to one."""
    x = x / np.sqrt((x * x).sum(axis=0))
    inner = x.T @ (a @ x)
    middle = np.trace(inner) / len(inner)
    small = inner - middle * (x.T @ x)
    scale = np.abs(small).max()
    if not scale:
        return x
    _, turn = np.linalg.eigh(((small + small.T) / (2 * scale)).astype(float))
    return x @ turn[:, ::-1].astype(np.longdouble)


def principal(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors, the largest entry of each above zero."""
    scale = np.trace(covariance) or np.longdouble(1)
    single = (covariance / scale).astype(np.float32)
    _, start = np.linalg.eigh(single)
    values, vectors = refine(covariance / scale, start[:, ::-1])
    order = np.argsort(-values, kind="stable")
    values, vectors = (values * scale)[order], vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(len(top))] < 0, -1, 1)


def fit_list(vectors: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """(width, x, copies): every distinct vector of whole numbers once, packed.

    Equal rows of a task count as one before they are shuffled.
    """
    bounded_batches(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            for _, matrix in finite_rows(batch.column(1)):
                x = whole_numbers(matrix, scale, LIMIT) + offset
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), x.shape[1], np.int32)),
                     pa.array(packed(x), pa.binary())], names=["width", "x"])

    rows = narrow(vectors, id_col, vector_col).mapInArrow(run, "width int, x binary")
    return written(rows.groupBy("width", "x").agg(F.count(F.lit(1)).alias("copies")), "fit-list")


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
        components: int = 16, scale: int = 64, offset: int = 1_000_000,
        ) -> tuple[Whitening, DataFrame] | None:
    """The whitening of a table, and its fit list; None without a vector that takes part.

    The driver holds one covariance matrix, width times width, and nothing that
    grows with the rows.
    """
    distinct = fit_list(vectors, id_col, vector_col, scale, offset)
    widths = distinct.groupBy("width").agg(F.sum("copies").alias("rows"),
                                           F.count(F.lit(1)).alias("n"))
    best = widths.orderBy(F.desc("rows"), "width").first()
    if best is None:
        return None
    width, n = best["width"], best["n"]
    rows = distinct.filter(F.col("width") == width)
    cells = _exact_cells(rows, width, None)
    model = Whitening(width, n, [cells[i, -1] for i in range(width)],
                      np.zeros((width, 0)), np.zeros(0), 0.0, scale, offset)
    if not width:
        return model, rows
    centre, rest = model.centre, model.rest
    cells = _exact_cells(rows, width, centre)
    covariance = np.zeros((width, width), np.longdouble)
    for (i, j), value in cells.items():
        covariance[i, j] = covariance[j, i] = extended(n * value - rest[i] * rest[j], n * n)
    values, found = principal(covariance)
    real = values > width * np.finfo(float).eps * max(values[0], 0)
    keep = np.flatnonzero(real)[:components]
    model.vectors, model.values = found[:, keep].astype(float), values[keep].astype(float)
    model.trace = float(np.trace(covariance))
    return model, rows


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, measured on its rows."""
    k = model.vectors.shape[1]

    def run(batches):
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for x in batches_of(batch.column(0), model.width):
                w = model.projected(x - np.array(model.centre, np.int64))
                total += w.T @ w
                sums += w.sum(axis=0)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([i, np.arange(k)]).astype(np.int32)),
             pa.array(np.concatenate([j, np.full(k, -1)]).astype(np.int32)),
             pa.array(np.concatenate([total[i, j], sums]))], names=["i", "j", "value"])

    found = rows.select("x").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(
        F.sum("value").alias("value")).collect()
    cells = {(r["i"], r["j"]): r["value"] / model.n for r in found}
    return max(abs(v - cells[i, -1] * cells[j, -1] - (i == j))
               for (i, j), v in cells.items() if j >= 0)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """A row for each vector and component: ``id_col``, component, n, deviation, whitened,
    explained and identity_error."""
    spark = vectors.sparkSession
    rows = narrow(vectors, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    schema = (f"{id_col} {kind}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    made = fit(vectors, id_col, vector_col, components, scale, offset)
    if made is None or not made[0].vectors.shape[1]:
        return spark.createDataFrame([], schema)
    model, distinct = made
    error = identity_error(distinct, model)
    bounded_batches(spark)

    def run(batches):
        k = model.vectors.shape[1]
        for batch in batches:
            for at, matrix in finite_rows(batch.column(1)):
                if matrix.shape[1] != model.width:
                    continue
                centred = whole_numbers(matrix, scale, LIMIT) + (
                    offset - np.array(model.centre, np.int64))
                each = np.arange(len(at)).repeat(k)
                deviations = pa.array(model.deviations(centred), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at[each])),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                     pa.array(np.full(len(each), model.n)), deviations.take(pa.array(each)),
                     pa.array(model.projected(centred).ravel()),
                     pa.array(np.tile(model.values / model.trace, len(at))),
                     pa.array(np.full(len(each), error))],
                    names=[f.strip().split()[0] for f in schema.split(",")])

    return rows.mapInArrow(run, schema)


assert ROWS_AT_ONCE << 2 * PART_BITS < 1 << 53
