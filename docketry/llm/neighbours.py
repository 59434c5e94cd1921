"""Near-duplicate vectors: links by cosine, through navigable small-world graphs.

Rows are dealt into shards of bounded size, and a task builds a graph for each
(see ``hnsw``). Graphs go out in groups of bounded bytes, and every vector
queries every shard where it lies. An audit first finds how wide beams start: a
sample of vectors, each turned away until it is barely within the link angle, is
searched by the graphs and by brute force over all rows, and beams double until
the graphs find as many links. Cosines of what is found are measured in double
precision. A task joins what it finds by union and sends a spanning forest, never
all pairs of a group; components are united from these.

Links are then counted among the vectors of each component, exactly. In a large
component the vectors within half the link angle of its first vector are all
linked with each other, which takes no comparison; vectors farther out meet the
component in blocks.

Vectors that are null, all zero, empty, or hold a null or non-finite number link
with nothing and come back as components of their own; so do vectors of unlike
width among each other. Every row is a vector, whether or not its id or its numbers repeat;
equal vectors link. A component's id is its smallest id, null if it has none.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_within
from .common import bounded_batches, written
from .components import connected
from .hnsw import Graph, build
from .vectors import finite_rows, narrow

THRESHOLD = 0.95
# Rows of a shard, bytes of graphs that go out together, and rows of a task that searches.
SHARD_ROWS, GROUP_BYTES, TASK_ROWS = 16_384, 64 << 20, 4_096
# Sampled vectors of an audit, the share of links that beams must find, and the first beam.
AUDIT_ROWS, RECALL, BEAM = 512, 0.99, 32
# Vectors of a block that are compared with each other at once, and of a component that is one.
BLOCK = 512
# Rounding of an angle; pairs nearer than this to the link angle are compared.
ANGLE_SLACK = 1e-9
_COUNTS = "row long, n long"


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a length, and those rows scaled to length one."""
    size = np.abs(matrix).max(axis=1, initial=0)
    some = np.flatnonzero(size > 0)
    scaled = matrix[some] / size[some, None]
    return some, scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of packed doubles of one width."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), float).reshape(len(rows), -1)


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, width, u): all rows, numbered; u is null for those that link with nothing.

    The table is written: row numbers hold whatever executors are lost.
    """
    bounded_batches(vectors.sparkSession)
    rows = narrow(vectors, id_col, vector_col).select(
        F.monotonically_increasing_id().alias("row"), "id", "w")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            width = np.zeros(batch.num_rows, np.int32)
            packed: list[bytes | None] = [None] * batch.num_rows
            for at, matrix in finite_rows(batch.column(2)):
                some, unit = unit_rows(matrix)
                for i, u in zip(at[some], unit):
                    width[i], packed[i] = len(u), u.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(width), pa.array(packed, pa.binary())],
                names=["row", "id", "width", "u"])

    return written(rows.mapInArrow(run, f"row long, id {kind}, width int, u binary"), "units")


def shard_graphs(units: DataFrame, threshold: float, shard_rows: int) -> tuple[DataFrame, list] | None:
    """A graph a shard: (shard, width, graph), and its size on the driver; None without vectors.

    Rows go to shards by a hash of their number, so a group of copies is spread
    over all shards of its width. A shard is one task.
    """
    spark = units.sparkSession
    counts = units.filter("u is not null").groupBy("width").count().collect()
    if not counts:
        return None
    plan, first = [], 0
    for r in sorted(counts):
        shards = -(-r["count"] // shard_rows)
        plan.append((r["width"], first, shards))
        first += shards
    dealt = units.join(F.broadcast(spark.createDataFrame(
        plan, "width int, first int, shards int")), "width").filter("u is not null").select(
        (F.col("first") + F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")).alias("shard"),
        "width", "row", "u")
    tasks = dealt.repartitionById(first, F.col("shard"))

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for shard in np.unique(batch.column(0)):
                part = batch.filter(pa.array(np.asarray(batch.column(0)) == shard))
                found.setdefault(int(shard), []).append(
                    (part.column(1)[0].as_py(), np.asarray(part.column(2)),
                     matrix_of(part.column(3))))
        for shard in list(found):
            parts = found.pop(shard)
            graph = build(np.concatenate([r for _, r, _ in parts]),
                          np.concatenate([u for _, _, u in parts]), threshold)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([parts[0][0]], pa.int32()),
                 pa.array([graph.to_bytes()], pa.binary())], names=["shard", "width", "graph"])

    graphs = written(tasks.mapInArrow(run, "shard int, width int, graph binary"), "graphs")
    sizes = graphs.select("shard", F.octet_length("graph").alias("n")).orderBy("shard").collect()
    return graphs, [(r["shard"], r["n"]) for r in sizes]


def probes(units: DataFrame, threshold: float, rows: int) -> dict[int, np.ndarray]:
    """By width: sampled vectors, turned away until they are barely within the link angle."""
    picked = units.filter("u is not null").select("width", "row", "u").orderBy(
        F.xxhash64("row", F.lit(1)), "row").limit(rows).collect()
    found: dict[int, list] = {}
    for r in picked:
        u = np.frombuffer(r["u"], float)
        away = np.random.default_rng(r["row"] & 0x7FFFFFFF).normal(size=len(u))
        away -= (away @ u) * u
        length = np.linalg.norm(away)
        cosine = threshold + 0.02 * (1 - threshold)
        if length > 1e-6:
            u = cosine * u + math.sqrt(1 - cosine * cosine) * away / length
        found.setdefault(r["width"], []).append(u / np.linalg.norm(u))
    return {w: np.array(u) for w, u in found.items()}


def count_by_brute_force(units: DataFrame, asked: dict[int, np.ndarray], threshold: float) -> int:
    """Links of the probes among all rows; a task meets them in blocks."""
    shipped = units.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        total = 0
        for batch in batches:
            for width, q in shipped.value.items():
                part = batch.filter(pa.array(np.asarray(batch.column(0)) == width))
                for at in range(0, part.num_rows, BLOCK):
                    total += int((matrix_of(part.column(1).slice(at, BLOCK)) @ q.T
                                  >= threshold).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["n"])

    return units.filter("u is not null").select("width", "u").mapInArrow(run, "n long").agg(
        F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def count_by_graphs(graphs: DataFrame, asked: dict[int, np.ndarray], threshold: float,
                    size: int) -> int:
    """Links of the probes that beams from ``size`` on find in all shards."""
    shipped = graphs.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        total = 0
        for batch in batches:
            for width, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if width in shipped.value:
                    total += sum(len(a) for a, _ in Graph.from_bytes(data).linked(
                        shipped.value[width], threshold, size, True))
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["n"])

    return graphs.select("width", "graph").mapInArrow(run, "n long").agg(
        F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def audited_beam(units: DataFrame, graphs: DataFrame, threshold: float, recall: float = RECALL,
                 size: int = BEAM, rows: int = AUDIT_ROWS) -> tuple[int, float]:
    """The first beam whose recall on the audit is ``recall`` or more, and that recall.

    Beams of a quarter of a shard compare every node, so the doubling ends.
    """
    asked = probes(units, threshold, rows)
    truth = count_by_brute_force(units, asked, threshold)
    while True:
        share = count_by_graphs(graphs, asked, threshold, size) / max(1, truth)
        if share >= recall or size >= SHARD_ROWS:
            return size, share
        size *= 2


class Forest:
    """Sets of row numbers; ``join`` says whether two rows were apart until then."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, row: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(row, row)) != row:
            parent[row] = parent[up]
            row = parent[row]
        return row

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def links(units: DataFrame, graphs: DataFrame, sizes: list, threshold: float, size: int,
          group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(a, b): rows linked, a spanning forest of what each task finds.

    Graphs go out in groups of at most ``group_bytes`` (or one graph); each group
    is one pass over the vectors.
    """
    spark = units.sparkSession
    asked = units.filter("u is not null").select("row", "width", "u")
    tasks = max(spark.sparkContext.defaultParallelism, -(-asked.count() // TASK_ROWS))
    asked = asked.repartition(tasks)
    out, at = None, 0
    while at < len(sizes):
        stop, total = at + 1, sizes[at][1]
        while stop < len(sizes) and total + sizes[stop][1] <= group_bytes:
            total += sizes[stop][1]
            stop += 1
        group = graphs.filter(F.col("shard").between(sizes[at][0], sizes[stop - 1][0]))
        shipped = spark.sparkContext.broadcast([(r["width"], r["graph"]) for r in group.collect()])
        found = written(asked.mapInArrow(_search(shipped, threshold, size), "a long, b long"),
                        "links")
        shipped.destroy()
        out = found if out is None else out.unionByName(found)
        at = stop
    return out


def _search(shipped, threshold: float, size: int):
    def run(batches):
        graphs = [(width, Graph.from_bytes(data)) for width, data in shipped.value]
        forest = Forest()
        for batch in batches:
            widths = np.asarray(batch.column(1))
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                rows, q = np.asarray(part.column(0)), matrix_of(part.column(2))
                for _, graph in (g for g in graphs if g[0] == width):
                    a, b = [], []
                    for who, point in graph.linked(q, threshold, size, False):
                        for x, y in zip(rows[who].tolist(), graph.rows[point].tolist()):
                            if forest.join(x, y):
                                a.append(x)
                                b.append(y)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _block_counts(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of the rows of a in b, and of the rows of b in a."""
    close = a @ b.T >= threshold
    return close.sum(axis=1), close.sum(axis=0)


def _counted(rows, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(rows, np.int64)), pa.array(np.asarray(counts, np.int64))],
        names=["row", "n"])


def small_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(row, n) of components of at most ``BLOCK`` vectors; a task takes many, one at a time."""
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        root = None
        def flush():
            rows = np.concatenate([r for r, _ in held])
            u = np.concatenate([x for _, x in held])
            held.clear()
            return _counted(rows, _block_counts(u, u, threshold)[0] - 1)

        for batch in batches:
            roots = np.asarray(batch.column(0))
            edges = [0, *(np.flatnonzero(np.diff(roots)) + 1).tolist(), len(roots)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if held and roots[lo] != root:
                    yield flush()
                root = roots[lo]
                held.append((np.asarray(batch.column(1).slice(lo, hi - lo)),
                             matrix_of(batch.column(2).slice(lo, hi - lo))))
        if held:
            yield flush()

    ordered = members.select("root", "row", "u").repartition("root").sortWithinPartitions("root")
    return ordered.mapInArrow(run, _COUNTS)


def large_counts(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(row, n), partial counts to be added up, of components of any size.

    The root is the pivot. With the angles a and b of two vectors to it, their
    own angle is at most a + b: the core, within half the link angle, is linked
    throughout. Vectors outside it meet blocks of the whole component; no pair is sent.
    """
    half = math.acos(threshold) / 2 - ANGLE_SLACK
    pivots = members.filter(F.col("row") == F.col("root")).select(
        F.col("root").alias("_root"), F.col("u").alias("_pivot"))

    def angle(batches):
        for batch in batches:
            cosine = np.einsum("ij,ij->i", matrix_of(batch.column(2)), matrix_of(batch.column(3)))
            core = np.arccos(np.clip(cosine, -1, 1)) <= half
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(core)], names=["root", "row", "u", "core"])

    placed = written(
        members.join(broadcast_within(pivots), F.col("root") == F.col("_root"))
        .select("root", "row", "u", "_pivot")
        .mapInArrow(angle, "root long, row long, u binary, core boolean"), "angles")
    sizes = placed.groupBy("root").agg(
        F.count_if("core").alias("inner"), F.count_if(~F.col("core")).alias("outer"))
    sizes = written(sizes.withColumns({
        "inner_blocks": F.ceil(F.col("inner") / block), "outer_blocks": F.ceil(F.col("outer") / block)}),
        "cores")
    sized = placed.join(broadcast_within(sizes), "root")
    counts = sized.filter("core").select("row", (F.col("inner") - 1).alias("n"))
    if sizes.filter("outer > 0").isEmpty():
        return counts
    # Blocks 0 to outer_blocks - 1 are outside the core, the others inside.
    blocked = sized.filter("outer > 0").withColumn("block", F.when(
        F.col("core"), F.col("outer_blocks") + F.pmod(F.xxhash64("row"), F.col("inner_blocks")))
        .otherwise(F.pmod(F.xxhash64("row"), F.col("outer_blocks"))))
    every = F.sequence(F.lit(0), F.col("outer_blocks") + F.col("inner_blocks") - 1)
    outer = blocked.filter(~F.col("core")).select(
        "root", F.col("block").alias("i"), F.explode(every).alias("j"), "row", "u")
    whole = blocked.select(
        F.col("root").alias("b_root"),
        F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1)).alias("b_i"),
        F.col("block").alias("b_j"), F.col("core").alias("b_core"), F.col("row").alias("b_row"),
        F.col("u").alias("b_u"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        left, right = a.column("row").to_numpy(), b.column("b_row").to_numpy()
        ahead, back = _block_counts(matrix_of(a.column("u")), matrix_of(b.column("b_u")), threshold)
        out = [_counted(left, ahead - np.isin(left, right))]
        # A vector outside the core is in the left side of a cell of its own.
        core = b.column("b_core").to_numpy(zero_copy_only=False)
        out.append(_counted(right[core], back[core]))
        return pa.Table.from_batches(out)

    met = outer.groupBy("root", "i", "j").cogroup(
        whole.groupBy("b_root", "b_i", "b_j")).applyInArrow(cell, _COUNTS)
    return counts.unionByName(met)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                 vector_col: str = "embedding", shard_rows: int = SHARD_ROWS,
                 block: int = BLOCK) -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept."""
    units = unit_vectors(vectors, id_col, vector_col)
    alone = units.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                         F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    made = shard_graphs(units, threshold, shard_rows)
    if made is None:
        return alone
    size, _ = audited_beam(units, made[0], threshold)
    found = connected(links(units, *made, threshold, size))
    if found is None:
        return alone
    members = written(units.join(found.withColumnRenamed("node", "row"), "row")
                      .select("root", "row", "id", "u"), "members")
    groups = written(members.groupBy("root").agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("component_id")), "groups")
    sized = members.join(broadcast_within(groups), "root")
    counts = small_counts(sized.filter(F.col("size") <= block), threshold)
    if not groups.filter(F.col("size") > block).isEmpty():
        large = written(sized.filter(F.col("size") > block).select("root", "row", "u"), "large")
        counts = counts.unionByName(large_counts(large, threshold, block))
    counts = counts.groupBy("row").agg(F.sum("n").alias("n_links"))
    linked = sized.select("row", "component_id").join(counts, "row")
    return units.select("row", "id").join(
        linked.withColumn("_linked", F.lit(True)), "row", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("_linked"), F.col("id").eqNullSafe(F.col("component_id")))
        .otherwise(F.lit(True)).alias("kept"))
