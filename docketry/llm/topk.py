"""Exact top-k inner products, pruned with multi-resolution segment statistics.

A vector is cut into segments, 4 coarse and 16 fine ones. With the sum S and the
deviation D of every segment (D * D = sum of squares - S * S / length), the inner
product over a segment is at most Sq * Sx / length + Dq * Dx (Cauchy-Schwarz on
the deviations); since |q - x|^2 = |q|^2 + |x|^2 - 2 q.x this is the same as a
lower bound of the distance. Pairs whose coarse bound misses the query's k-th
best score so far are dropped, then those whose fine bound does, and exact
scores are computed for the survivors only. Nothing that could rank is dropped.

Vectors are integers: floor(``scale`` * x). Queries go out in blocks of bounded
size, and a block meets the vectors where they lie. Slices of the vectors come
in growing order, each 16 times the one before, so a k-th score found in a small
slice bounds what the next one emits to about 16 k rows a query, in sum a
multiple of the logarithm of the table.

Vectors that are null, hold null or non-finite components, or have no id take no
part. Vectors of another length than a query are no candidates of it. A query row
that is repeated counts once, with the rows that repeat it as candidates but for one; a row
with the query's id and other numbers is a candidate like any other. Repeated
vectors are each a candidate and tie by id. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, worker_table, written

LEVELS = (4, 16)
# Queries of one block, and vectors of its first slice.
BLOCK, FIRST_SLICE, GROWTH = 16_384, 4_096, 16
ROWS_AT_ONCE, QUERIES_AT_ONCE = 4_096, 512


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): rows that take part, v an array of longs."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    return (df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), wide.alias("w")).filter(
        F.forall("w", lambda x: x.isNotNull() & ~F.isnan(x)
                 & (F.abs(x) != float("inf"))))
            .select("id", F.transform("w", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v")))


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner product bounds that of the vectors from above."""
    n, width = x.shape
    bounds = [width * i // segments for i in range(segments + 1)]
    out = np.zeros((n, 2 * segments))
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if a == b:
            continue
        part = x[:, a:b]
        total = part.sum(axis=1)
        out[:, i] = total / np.sqrt(b - a)
        out[:, segments + i] = np.sqrt(np.maximum(
            0, np.einsum("ij,ij->i", part, part) - total * total / (b - a)))
    return out


@dataclass
class Queries:
    """Queries of one length, with their statistics and the score that each has to reach."""
    number: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    features: list[np.ndarray]
    floor: np.ndarray


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, exact in integers."""
    return np.einsum("ij,ij->i", q, x)


def candidates(queries: Queries, ids: np.ndarray, x: np.ndarray, floor: np.ndarray):
    """(query row, vector row, score) of all pairs that reach ``floor``; bounds go first."""
    wide = x.astype(float)
    features = [segment_features(wide, s) for s in LEVELS]
    # Rounding in the bounds is far below this slack; scores are whole numbers.
    slack = 0.5 + 1e-9 * (np.abs(wide).max(initial=0) * np.abs(queries.vectors).max(initial=0)
                          * max(1, x.shape[1]))
    for lo in range(0, len(queries.ids), QUERIES_AT_ONCE):
        part = slice(lo, lo + QUERIES_AT_ONCE)
        coarse = queries.features[0][part] @ features[0].T
        qi, xi = np.nonzero(coarse + slack >= floor[part, None])
        for at in range(0, len(qi), 1 << 18):
            a, b = qi[at:at + (1 << 18)] + lo, xi[at:at + (1 << 18)]
            fine = np.einsum("ij,ij->i", queries.features[1][a], features[1][b])
            near = fine + slack >= floor[a]
            a, b = a[near], b[near]
            score = exact_scores(queries.vectors[a], x[b])
            real = score >= floor[a]
            yield a[real], b[real], score[real]


def best_of(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the k best of their query."""
    order = np.lexsort((ids, -score, q))
    sorted_q = q[order]
    start = np.searchsorted(sorted_q, sorted_q)
    return order[np.arange(len(order)) - start < k]


class Search:
    """The k best rows so far of every query of a task; grows with queries, not with rows."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k, self.floor = queries, k, queries.floor.copy()
        self.best = (np.zeros(0, np.int64),) * 3

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for a, b, score in candidates(self.queries, ids, x, self.floor):
            best = tuple(np.concatenate(p) for p in zip(self.best, (a, ids[b], score)))
            keep = best_of(*best, self.k)
            self.best = tuple(p[keep] for p in best)
        counts = np.bincount(self.best[0], minlength=len(self.floor))
        worst = np.full(len(self.floor), np.iinfo(np.int64).max)
        np.minimum.at(worst, self.best[0], self.best[2])
        full = counts >= self.k
        self.floor[full] = np.maximum(self.floor[full], worst[full])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 256, block: int = BLOCK,
          first_slice: int = FIRST_SLICE) -> DataFrame:
    """(query_id, rank, id, score): the k best of all vectors but the query's own row.

    ``queries`` are rows of ``vectors``. One candidate more than ``k`` is looked for, so that
    the own row, which is known by its id and score, can be taken out last: rows of
    one id and one score are alike in the result.
    """
    spark = vectors.sparkSession
    k += 1
    rows = quantised(vectors, id_col, vector_col, scale)
    wanted = quantised(queries, id_col, vector_col, scale).distinct()
    total, count = rows.count(), wanted.count()
    blocks = max(1, -(-count // block))
    if blocks > 1:
        wanted = written(wanted.withColumn("_b", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))),
                         "queries")
    # Slices by a hash of the id: the first few, then 16 times as many, up to all.
    shares, reach = [], float(first_slice)
    while reach < total:
        shares.append(reach / total)
        reach *= GROWTH
    edges = [0] + [int(s * (1 << 30)) for s in shares] + [1 << 30]
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    result = None
    for b in range(blocks):
        # At most about ``block`` rows of one width.
        got = (wanted if blocks == 1 else wanted.filter(F.col("_b") == b)).select("id", "v").toPandas()
        found = None
        floor = np.full(len(got), np.iinfo(np.int64).min)
        for n, (lo, hi) in enumerate(zip(edges, edges[1:])):
            part = rows if len(edges) == 2 else rows.filter((place >= lo) & (place < hi))
            here = _ranked(_scan(spark, part, got, floor, k), found, k)
            if n < len(edges) - 2:
                found = written(here, "topk")
                reached = found.filter(F.col("rank") == k).select("number", "score").toPandas()
                floor[reached["number"].to_numpy()] = reached["score"].to_numpy()
            else:
                found = here
        own = [int(np.dot(np.array(v, np.int64), np.array(v, np.int64))) for v in got["v"]]
        names = spark.createDataFrame(
            [(i, int(x), s) for i, (x, s) in enumerate(zip(got["id"], own))],
            "number int, query_id long, _own long")
        found = _without_own(found.join(F.broadcast(names), "number"), k)
        result = found if result is None else result.unionByName(found)
    return result.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _without_own(found: DataFrame, most: int) -> DataFrame:
    """The rows but one of the query's id and own score; without it among them, but the last."""
    mine = (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("_own"))
    per_query = Window.partitionBy("number")
    at = F.min(F.when(mine, F.col("rank"))).over(per_query)
    gone = F.coalesce(at, F.lit(most))
    return found.withColumn("_gone", gone).filter(F.col("rank") != F.col("_gone")).withColumn(
        "rank", F.when(F.col("rank") > F.col("_gone"), F.col("rank") - 1).otherwise(F.col("rank")))


def _scan(spark, rows: DataFrame, got, floor: np.ndarray, k: int) -> DataFrame:
    packed = []
    lengths = np.array([len(v) for v in got["v"]], int)
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        x = np.array([got["v"].iloc[i] for i in at], np.int64).reshape(len(at), -1)
        packed.append(Queries(at, got["id"].to_numpy(np.int64)[at], x,
                              [segment_features(x.astype(float), s) for s in LEVELS], floor[at]))
    shipped = spark.sparkContext.broadcast(packed)

    bounded_batches(spark)

    def run(batches):
        import pyarrow as pa

        worker_table(None)
        searches = [Search(queries, k) for queries in shipped.value]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            """Meet the rows held with the queries of their length."""
            for search in searches:
                width = search.queries.vectors.shape[1]
                ids, xs = [], []
                for batch_ids, values, offsets in held:
                    rows = np.flatnonzero(np.diff(offsets) == width)
                    ids.append(batch_ids[rows])
                    xs.append(values[offsets[rows][:, None] + np.arange(width)])
                search.add(np.concatenate(ids), np.concatenate(xs).reshape(-1, width))
            held.clear()

        for batch in batches:
            column = batch.column(1)
            offsets = np.asarray(column.offsets).astype(np.int64)
            held.append((np.asarray(batch.column(0)).astype(np.int64),
                         np.asarray(column.flatten()).astype(np.int64), offsets - offsets[0]))
            if sum(len(h[0]) for h in held) >= ROWS_AT_ONCE:
                flush()
        if held:
            flush()
        for search in searches:
            q, i, s = search.best
            yield pa.RecordBatch.from_arrays(
                [pa.array(search.queries.number[q].astype(np.int32)), pa.array(i), pa.array(s)],
                names=["number", "id", "score"])

    return rows.mapInArrow(run, "number int, id long, score long")


def _ranked(scored: DataFrame, before: DataFrame | None, k: int) -> DataFrame:
    if before is not None:
        scored = scored.unionByName(before.select("number", "id", "score"))
    order = Window.partitionBy("number").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
