"""Vector work on whole Arrow batches: preparation and cosine top-k.

Spark partitions, shuffles and merges; inside a task numpy handles a batch of
vectors at once, since per-element expressions are slow on wide vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import (NORM_FLOOR, SCORE_DECIMALS, WORST_SCORE, cosine_score,
                                 sanitize_and_normalize)
from ..session import bound_arrow_batches, cut_lineage

# Queries whose vectors are sent to every task at once, and their bytes as doubles.
BROADCAST_QUERIES, QUERY_BYTES = 4096, 64 << 20
# Rows of the first sample that bars are found in, and how much larger the next one is.
FIRST_SLICE, GROWTH = 4096, 16
# Partial rows of one scan: a large store is scanned by fewer tasks that each pass more files.
PARTIAL_ROWS = 1_000_000_000
# Blocks of queries that are searched one after the other; more of them are searched in cells.
SCAN_BLOCKS = 8
# Queries, and hits of all of them, that a cell holds, and the vectors that pass it.
CELL_QUERIES, CELL_HITS, CELL_VECTORS = 32_768, 2_000_000, 1 << 20
# Score matrix elements held at a time in a task, and vectors that a block of them is wide.
_BLOCK, _TILE = 4_000_000, 1024
# Hits with their urls that wait in a task for being merged.
WAITING_HITS = 500_000
_HIT_SCHEMA = "query_id long, url string, stage1_score double"
_HIT_ARROW = pa.schema([("query_id", pa.int64()), ("url", pa.string()),
                        ("stage1_score", pa.float64())])

_STATS_ARROW = pa.schema([
    ("n_rows", pa.int64()), ("dim", pa.int32()), ("hi", pa.float64()), ("lo", pa.float64()),
    ("total", pa.float64()), ("nan", pa.bool_()), ("inf", pa.bool_()), ("tiny", pa.int64()),
    ("bad_values", pa.int64()), ("bad_rows", pa.int64())])


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as an (n, d) float32 matrix, without copying row by row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count:
        raise ValueError("null vector")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if n and (lengths != lengths[0]).any():
        raise ValueError("vectors of unequal length")
    return flat.astype(np.float32, copy=False).reshape(n, -1) if n else np.zeros((0, 0), np.float32)


def _list_array(matrix: np.ndarray) -> pa.ListArray:
    n, d = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)) if d else pa.array(
        np.zeros(n + 1, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), type=pa.float32()))


def _prepare(matrix: np.ndarray) -> np.ndarray:
    """Zero bad elements, scale rows to unit length, back to float precision."""
    wide = np.nan_to_num(matrix, nan=0.0, posinf=0.0, neginf=0.0).astype(np.float64)
    norms = np.maximum(np.sqrt((wide * wide).sum(axis=1, keepdims=True)), NORM_FLOOR)
    return (wide / norms).astype(np.float32)


def prepare_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """``sanitize_and_normalize`` over a table, batch by batch."""
    index = df.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                done = _list_array(_prepare(_matrix(batch.column(index))))
                columns = [done if i == index else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


_STATS = ("n_rows long, dim int, hi double, lo double, total double, nan boolean, inf boolean,"
          " tiny long, bad_values long, bad_rows long")


def block_stats(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row of partial statistics per Arrow batch, for aggregates over whole stores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            bad, size = ~np.isfinite(x), np.abs(x)
            row = {
                "n_rows": len(x), "dim": x.shape[1],
                "hi": float(np.fmax.reduce(x, axis=None)),
                "lo": float(np.fmin.reduce(x, axis=None)),
                "total": float(x.sum(dtype=np.float64)), "nan": bool(np.isnan(x).any()),
                "inf": bool(np.isinf(x).any()), "tiny": int(((size > 0) & (size < 1e-30)).sum()),
                "bad_values": int(bad.sum()), "bad_rows": int(bad.any(axis=1).sum())}
            yield pa.RecordBatch.from_pylist([row], schema=_STATS_ARROW)

    return vectors.select(vec).mapInArrow(run, _STATS)


def _margin(width: int) -> float:
    """Sums of float products of unit vectors are off by less than half of this."""
    return 2 * (width + 8) * 2.0 ** -23 + 10.0 ** -SCORE_DECIMALS


def _near(queries: np.ndarray, docs: np.ndarray, k: int, floor: np.ndarray, margin: float,
          ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query row, vector row and score of the pairs that may be among the k best.

    Products in float precision leave out what cannot be, with a margin wider than their
    error; scores of the others are sums in double precision. Blocks of products fit a
    core's cache, but for queries without a bar yet, which need whole rows of them.
    """
    n = len(docs)
    if not n:
        return
    wide = docs.astype(np.float64)
    barred = np.isfinite(floor)
    for rows, across in ((np.flatnonzero(~barred), n), (np.flatnonzero(barred), _TILE)):
        step = max(1, _BLOCK // 8 // min(n, across))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            part, least = queries[some], floor[some]
            bars = (least - margin).astype(np.float32)
            for start in range(0, n, across):
                rough = part @ docs[start:start + across].T
                m = rough.shape[1]
                if across == n and m > k:
                    kth = np.partition(rough, m - k, axis=1)[:, m - k]
                    bars = np.maximum(bars, kth - np.float32(margin))
                flat = np.flatnonzero(rough >= bars[:, None])
                for first in range(0, len(flat), 65_536):
                    q, doc = np.divmod(flat[first:first + 65_536], m)
                    doc += start
                    scores = np.round(np.einsum("ij,ij->i", part[q].astype(np.float64),
                                                wide[doc]), SCORE_DECIMALS)
                    scores[~np.isfinite(scores)] = WORST_SCORE
                    good = scores >= least[q]
                    yield some[q[good]], doc[good], scores[good]


class _TopK:
    """The k best (score descending, url ascending) per query seen so far in one task."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k = ids, k
        self.queries = _prepare(matrix)
        self.margin = _margin(matrix.shape[1])
        # A vector below its query's floor cannot be among the k best.
        self.floor = floor.copy()
        self.best = None
        self.waiting: list[pa.Table] = []
        self.n_waiting = self.rows = self.merge_at = 0

    def add(self, urls: pa.Array, matrix: np.ndarray) -> None:
        if not len(self.ids):
            return
        # The first rows give bars for the others.
        edges = sorted({0, min(1024, len(urls)) if self.rows == 0 else 0, len(urls)})
        for start, till in zip(edges, edges[1:]):
            part = urls.slice(start, till - start)
            docs = _prepare(matrix[start:till])
            for q, doc, scores in _near(self.queries, docs, self.k, self.floor, self.margin):
                if len(q):
                    self.waiting.append(pa.table(
                        {"q": q, "s": scores, "u": part.take(pa.array(doc)).cast(pa.string())}))
                    self.n_waiting += len(q)
                if self.n_waiting > WAITING_HITS:
                    self._merge()
            self.rows += till - start
            if self.rows >= self.merge_at:
                self._merge()
                self.merge_at = 2 * self.rows

    def _merge(self) -> None:
        if not self.n_waiting:
            return
        table = pa.concat_tables(([] if self.best is None else [self.best]) + self.waiting)
        self.waiting, self.n_waiting = [], 0
        table = table.sort_by([("q", "ascending"), ("s", "descending"), ("u", "ascending")])
        q = table.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        self.best = table.filter(pa.array(place < self.k)).combine_chunks()
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], table.column("s").to_numpy()[last])

    def hits(self) -> pa.RecordBatch | None:
        self._merge()
        if self.best is None:
            return None
        return pa.RecordBatch.from_arrays([
            pa.array(self.ids[self.best.column("q").to_numpy()]),
            self.best.column("u").combine_chunks(),
            self.best.column("s").combine_chunks()], schema=_HIT_ARROW)


class _CellTopK:
    """The k best of each query of a cell, over vectors that pass in the order of their urls.

    Hits are kept by the number of their row, which is the order of urls.
    """

    def __init__(self, ids: pa.Array, matrix: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.floor = ids, k, floor.copy()
        self.queries = _prepare(matrix)
        self.margin = _margin(matrix.shape[1])
        self.urls: list[pa.Array] = []
        self.rows, self.merge_at = 0, 0
        empty = np.zeros(0, np.int64)
        self.waiting = [(empty, np.zeros(0), empty)]
        self.n_waiting = 0

    def add(self, urls: pa.Array, matrix: np.ndarray) -> None:
        for at in [0, 1024] if self.rows == 0 else [0]:
            till = 1024 if (at, self.rows) == (0, 0) else len(urls)
            if at < till and at < len(urls):
                self._add(urls.slice(at, till - at), matrix[at:till])

    def _add(self, urls: pa.Array, matrix: np.ndarray) -> None:
        docs = _prepare(matrix)
        n, d = docs.shape
        # Of equal vectors the k first urls are enough for any query.
        alike = np.zeros(n, np.int64) if d == 0 else np.unique(
            docs.view(np.dtype((np.void, 4 * d))).ravel(), return_inverse=True)[1].ravel()
        members = np.argsort(alike, kind="stable")
        starts = np.concatenate(([0], np.flatnonzero(np.diff(alike[members])) + 1))
        copies = np.minimum(np.diff(np.append(starts, n)), self.k)
        distinct = docs[members[starts]]
        for q, doc, scores in _near(self.queries, distinct, self.k, self.floor, self.margin):
            times = copies[doc]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            rows = members[np.repeat(starts[doc], times) + place] + self.rows
            self.waiting.append((np.repeat(q, times), np.repeat(scores, times), rows))
            self.n_waiting += len(rows)
            if self.n_waiting > CELL_HITS:
                self._merge()
        self.urls.append(urls.cast(pa.large_string()))
        self.rows += n
        if self.rows >= self.merge_at:
            self._merge()
            self.merge_at = 2 * self.rows

    def _merge(self) -> None:
        q, scores, rows = (np.concatenate(x) for x in zip(*self.waiting))
        order = np.lexsort((rows, -scores, q))
        q, scores, rows = q[order], scores[order], rows[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        last, kept = place == self.k - 1, place < self.k
        self.floor[q[last]] = np.maximum(self.floor[q[last]], scores[last])
        self.waiting, self.n_waiting = [(q[kept], scores[kept], rows[kept])], 0

    def hits(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        q, scores, rows = self.waiting[0]
        urls = pa.concat_arrays(self.urls) if self.urls else None
        for at in range(0, len(q), 65_536):
            part = slice(at, at + 65_536)
            yield pa.RecordBatch.from_arrays([
                self.ids.take(pa.array(q[part])), urls.take(pa.array(rows[part])).cast(pa.string()),
                pa.array(scores[part])], schema=_HIT_ARROW)


def _floors(column: pa.ChunkedArray) -> np.ndarray:
    return np.nan_to_num(column.to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)


def broadcast_queries(width: int) -> int:
    """How many queries of ``width`` numbers are sent to every task."""
    return max(1, min(BROADCAST_QUERIES, QUERY_BYTES // (8 * max(1, width))))


def scan_tasks(n_queries: int, k: int, cores: int) -> int:
    """Most tasks of a scan, so that partial rows stay bounded while every core has work."""
    return max(2 * cores, PARTIAL_ROWS // max(1, n_queries * k))


def _broadcast_hits(head: pa.Table, vectors: DataFrame, k: int) -> DataFrame:
    """All queries to every task; each task emits at most k rows per query.

    ``coalesce`` joins input splits without a shuffle and never adds any, so a
    task's running bar serves many files and partial rows do not grow with the store.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    vectors = vectors.coalesce(scan_tasks(head.num_rows, k, cores))
    payload = vectors.sparkSession.sparkContext.broadcast((
        head.column("query_id").to_numpy(), _matrix(head.column("q_vec")),
        _floors(head.column("floor"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, floor = payload.value
        top = _TopK(ids, matrix, k, floor)
        for batch in batches:
            top.add(batch.column(0), _matrix(batch.column(1)))
        found = top.hits()
        if found is not None:
            yield found

    return vectors.select("url", "embedding").mapInArrow(run, _HIT_SCHEMA)


def growing_slices(vectors: DataFrame, first: int = FIRST_SLICE) -> list[DataFrame]:
    """Samples of a table by a hash of the url, of ``first`` rows, 16 times as many, and so on.

    They are written once, and hold less than a tenth of the table in all.
    """
    total, places = vectors.count(), 1 << 30
    place = F.pmod(F.xxhash64("url"), F.lit(places))
    out = []
    reach = first
    while reach * GROWTH <= total:
        share = int(places * (reach / total))
        out.append(cut_lineage(vectors.select("url", "embedding").filter(place < share)))
        reach *= GROWTH
    return out


def _with_floor(head: pa.Table, best: DataFrame, k: int) -> pa.Table:
    """The queries with the k-th score of ``best`` as their bar, where that is higher."""
    known = best.filter(F.col("stage1_rank") == k).select("query_id", "stage1_score").toArrow()
    bars = dict(zip(known.column(0).to_pylist(), known.column(1).to_pylist()))
    floors = [max((x for x in (old, bars.get(i)) if x is not None), default=None) for i, old in
              zip(head.column("query_id").to_pylist(), head.column("floor").to_pylist())]
    return head.set_column(head.schema.get_field_index("floor"), "floor",
                           pa.array(floors, pa.float64()))


def _blocked_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int,
                  first_slice: int) -> DataFrame:
    """Any number of queries: a block of them at a time meets the vectors where they lie.

    Vectors are neither copied nor shuffled. Each block is searched in growing
    samples first; the k-th score there bars all but about 16 k rows a query of
    the full scan, whatever the number of tasks. A block's hits are written before the next.
    """
    n_blocks = max(1, math.ceil(queries.count() / block))
    tagged = cut_lineage(queries.withColumn(
        "_b", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")))
    slices = growing_slices(vectors, first_slice)
    out = None
    for b in range(n_blocks):
        head = tagged.filter(F.col("_b") == b).select("query_id", "q_vec", "floor").toArrow()
        if not head.num_rows:
            continue
        for part in slices:
            head = _with_floor(head, best_per_query(_broadcast_hits(head, part, k), k), k)
        found = cut_lineage(best_per_query(_broadcast_hits(head, vectors, k), k))
        out = found if out is None else out.unionByName(found)
    return out


def _cell_topk(queries: DataFrame, vectors: DataFrame, k: int, n_queries: int,
               width: int) -> DataFrame:
    """Any number of queries in one job: a group of them meets a part of the vectors in a task.

    A task holds the queries of its cell and their best hits; the vectors pass it one batch
    after another, so its running bars serve all of them and it emits at most k rows a query.
    There are as many groups as give every core work, and more where one would hold more than
    ``CELL_QUERIES`` or their bytes; vectors are copied once a group, and parts are one but for
    more than ``CELL_VECTORS`` vectors.
    """
    spark = queries.sparkSession
    bound_arrow_batches(spark)
    cores = spark.sparkContext.defaultParallelism
    held = max(1, min(CELL_QUERIES, CELL_HITS // max(1, k), QUERY_BYTES // (8 * max(1, width))))
    groups = max(2 * cores, math.ceil(n_queries / held))
    parts = max(1, math.ceil(vectors.count() / CELL_VECTORS))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Rows that repeat a query are dealt out like any others.
    asked = cut_lineage(queries).withColumn("_g", F.pmod(F.xxhash64(
        "query_id", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    asked = asked.withColumn("_p", every(parts)).select(
        (F.col("_g") * parts + F.col("_p")).alias("cell"), F.lit(True).alias("asks"), "query_id",
        F.lit(None).cast("string").alias("url"), F.col("q_vec").alias("vec"), "floor")
    stored = vectors.select("url", "embedding").withColumn("_p", F.pmod(F.xxhash64(
        "url", "embedding"), F.lit(parts)).cast("int")).withColumn("_g", every(groups)).select(
        (F.col("_g") * parts + F.col("_p")).alias("cell"), F.lit(False).alias("asks"),
        F.lit(None).cast("long").alias("query_id"), "url", F.col("embedding").alias("vec"),
        F.lit(None).cast("double").alias("floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, top, heads = None, None, []

        def ready() -> _CellTopK | None:
            if not heads:
                return None
            head = pa.Table.from_batches(heads)
            return _CellTopK(head.column("query_id").combine_chunks(),
                             _matrix(head.column("vec")), k, _floors(head.column("floor")))

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((np.diff(cells) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            edges = [0, *turns.tolist(), batch.num_rows]
            for at, till in zip(edges, edges[1:]):
                part = batch.slice(at, till - at)
                if not part.num_rows:
                    continue
                if cells[at] != now:
                    if top is not None:
                        yield from top.hits()
                    now, top, heads = cells[at], None, []
                if asks[at]:
                    heads.append(part)
                    continue
                if top is None:
                    top = ready()
                if top is not None:
                    top.add(part.column("url"), _matrix(part.column("vec")))
        if top is not None:
            yield from top.hits()

    # A cell's queries come ahead of its vectors, and these in the order of their urls.
    ordered = asked.unionByName(stored).repartitionById(groups * parts, F.col("cell"))
    hits = ordered.sortWithinPartitions("cell", F.desc("asks"), "url").mapInArrow(run, _HIT_SCHEMA)
    return cut_lineage(best_per_query(hits, k, buckets=1 if parts <= 16 else 16))


def best_per_query(hits: DataFrame, k: int, buckets: int = 16) -> DataFrame:
    """The k best of partial hits per query, ranked from 1.

    Merged in two steps: partial lists first meet per (query, bucket), so the
    last task of a query sees ``buckets * k`` rows however many tasks scanned.
    One bucket is for partial lists that are few already.
    """
    order = [F.desc("stage1_score"), F.asc("url")]
    if buckets == 1:
        return hits.withColumn("stage1_rank", F.row_number().over(
            Window.partitionBy("query_id").orderBy(*order))).filter(F.col("stage1_rank") <= k)
    salted = hits.withColumn("_b", F.pmod(F.xxhash64("url"), F.lit(buckets)))
    first = Window.partitionBy("query_id", "_b").orderBy(*order)
    final = Window.partitionBy("query_id").orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
        .select("query_id", "url", "stage1_score")
        .withColumn("stage1_rank", F.row_number().over(final))
        .filter(F.col("stage1_rank") <= k)
    )


def _topk(asked: DataFrame, vectors: DataFrame, k: int, max_broadcast_queries: int | None,
          first_slice: int) -> DataFrame:
    first = asked.select(F.coalesce(F.size("q_vec"), F.lit(1)).alias("n")).first()
    width = first["n"] if first else 1
    if max_broadcast_queries is None:
        max_broadcast_queries = broadcast_queries(width)
    head = asked.limit(max_broadcast_queries + 1).toArrow()
    if head.num_rows <= max_broadcast_queries:
        return best_per_query(_broadcast_hits(head, vectors, k), k)
    n_queries = asked.count()
    if n_queries > SCAN_BLOCKS * max_broadcast_queries:
        return _cell_topk(asked, vectors, k, n_queries, width)
    return _blocked_topk(asked, vectors, k, max_broadcast_queries, first_slice)


def semantic_topk(queries: DataFrame, vectors: DataFrame, k: int, *,
                  seed: DataFrame | None = None,
                  max_broadcast_queries: int | None = None,
                  first_slice: int = FIRST_SLICE) -> DataFrame:
    """The k nearest documents of every query: query_id, url, stage1_score, stage1_rank.

    Exact: every query meets every vector. Reads only url and embedding. Scores
    have nine places; ties go by url; a score that is not finite counts as -1.
    Up to ``max_broadcast_queries`` queries (by default set by the bytes of a vector)
    are sent to the tasks that scan the vectors; more queries go in blocks of
    so many, each with a bar found in samples of the vectors, the smallest of
    ``first_slice`` rows. Beyond ``SCAN_BLOCKS`` blocks one job searches them all,
    in cells of queries and vectors that are shuffled.

    ``seed`` may be any part of ``vectors``, such as one file of a large store.
    It is searched first, and its k-th score per query is a lower bound for the
    whole store, so the tasks of the full scan keep only what may still get in.
    """
    asked = queries.select(F.col("query_id").cast("long"), "q_vec")
    limits = (max_broadcast_queries, first_slice)
    no_floor = asked.withColumn("floor", F.lit(None).cast("double"))
    if seed is None:
        return _topk(no_floor, vectors, k, *limits)
    bounds = _topk(no_floor, seed, k, *limits).filter(
        F.col("stage1_rank") == k).select("query_id", F.col("stage1_score").alias("floor"))
    bounded = asked.join(bounds, "query_id", "left").select("query_id", "q_vec", "floor")
    return _topk(bounded, vectors, k, *limits)


def semantic_topk_single(vectors: DataFrame, q_vec: list[float], k: int) -> DataFrame:
    """One query given as numbers, without Python workers: url, stage1_score, best first."""
    query = sanitize_and_normalize(F.array(*[F.lit(float(x)).cast("float") for x in q_vec]))
    score = cosine_score(sanitize_and_normalize(F.col("embedding")), query)
    return (
        vectors.select("url", score.alias("stage1_score"))
        .orderBy(F.desc("stage1_score"), F.asc("url")).limit(k)
    )
