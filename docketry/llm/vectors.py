"""Vectors of whole Arrow batches: which rows hold numbers only, and whole numbers made of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows that a task works on at once.
ROWS_AT_ONCE = 4_096


def narrow(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, w): nothing else of a table is read; numbers become doubles."""
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("w"))


def finite_rows(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for every width among the rows that hold finite numbers only.

    Rows that are null or hold a null or non-finite number are left out. Rows of
    one width come together, at most ``ROWS_AT_ONCE`` of them.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    lengths = lengths.astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)   # null becomes NaN
    ends = np.cumsum(np.maximum(lengths, 0))
    starts = ends - np.maximum(lengths, 0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (lengths >= 0) & (bad[ends] == bad[starts])
    for width in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == width))
        for at in range(0, len(rows), ROWS_AT_ONCE):
            part = rows[at:at + ROWS_AT_ONCE]
            yield part, flat[starts[part][:, None] + np.arange(width)]


def whole_numbers(matrix: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as longs; beyond ``limit`` in size a number counts as ``limit``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * matrix), -limit, limit).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Rows of longs as bytes, each in the narrowest of 2, 4 or 8 bytes a number.

    Equal rows have equal bytes. With the width known, ``unpacked`` reads them back.
    """
    size = np.abs(x).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(x)
    for kind, low, high in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, None)):
        rows = np.flatnonzero((size >= low) & ((size < high) if high else True))
        raw = x[rows].astype(kind).tobytes()
        step = len(raw) // max(1, len(rows))
        for n, row in enumerate(rows):
            out[row] = raw[n * step:(n + 1) * step]
    return out


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """The matrix of longs that ``packed`` made rows of."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    if not width:
        return out
    sizes = np.array([len(r) // width for r in rows])
    for step in np.unique(sizes):
        at = np.flatnonzero(sizes == step)
        out[at] = np.frombuffer(b"".join(rows[i] for i in at), f"<i{step}").reshape(-1, width)
    return out


def batches_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """``unpacked`` in pieces of bounded size."""
    for at in range(0, len(column), ROWS_AT_ONCE):
        yield unpacked(column.slice(at, ROWS_AT_ONCE), width)
