"""Whitening, near vectors and centroid clusters against brute force, and on odd tables."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import hnsw, neighbours, simplex, whitening

ODD = [None, [], [math.nan] * 64, [math.inf] + [0.0] * 63, [None] + [1.0] * 63]
CLASH = ("id", "w", "x", "row", "u", "cluster", "component", "width", "root")
SCHEMA = "vec_id long, embedding array<float>"


def vectors(seed, n, width=64, scale=1.0):
    x = np.random.default_rng(seed).normal(size=(n, width))
    return (scale * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def table(spark, rows, clash=True):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v])
                                for i, v in rows], SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


def whole(x, scale=64):
    return np.floor(scale * np.asarray(x, float)).astype(np.int64)


# --- 11: whitening ------------------------------------------------------------------

@pytest.fixture(scope="module")
def some():
    x = vectors(1, 300)
    x[:100] += 0.7 * vectors(2, 1)
    return [*enumerate(x), (7, x[7]), (None, x[8]), *((1000 + i, v) for i, v in enumerate(ODD)),
            (2000, [1.0, 2.0])]


def test_whitening_is_that_of_exact_numbers(spark, some):
    got = whitening.whiten(table(spark, some)).toPandas()
    used = [(i, v) for i, v in some if v is not None and len(v) == 64
            and all(c is not None and math.isfinite(c) for c in v)]
    y = whole([v for _, v in used]) + 1_000_000
    distinct = np.unique(y, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    z = y - distinct.mean(axis=0)
    fitted = distinct - distinct.mean(axis=0)
    values, found = np.linalg.eigh(fitted.T @ fitted / n)
    values, found = values[::-1], found[:, ::-1]
    want = z @ found[:, :16] / np.sqrt(values[:16])
    assert len(got) == 16 * len(used) and set(got.component) == set(range(1, 17))
    assert (got.n == n).all() and got.identity_error.max() < 1e-12
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(shares, values[:16] / values.sum(), rtol=1e-10)
    mine = {(i, c): g for i, c, g in zip(got.vec_id, got.component, got.whitened) if i == i}
    away = {i: d for i, d in zip(got.vec_id, got.deviation) if i == i}
    for c in range(16):
        each = np.array([mine[i, c + 1] for i, _ in used if i is not None])
        real = want[[i is not None for i, _ in used], c]
        assert min(np.abs(each - real).max(), np.abs(each + real).max()) < 1e-9
    for (i, _), row in zip(used, y):
        if i is not None:
            assert away[i] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))
    assert got.vec_id.isna().sum() == 16


def test_whitening_of_few_and_of_equal_vectors(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(i, v) for i, v in enumerate(ODD)])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    got = whitening.whiten(table(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])])).collect()
    assert [(r.component, abs(r.whitened), r.explained) for r in got] == [(1, 1.0, 1.0)] * 2


def test_large_numbers_stay_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [0.0, 1e9]), (3, [5.0, -1e30])]
    got = whitening.whiten(table(spark, rows)).toPandas()
    assert set(got.vec_id) == {1, 2, 3} and got.identity_error.max() < 1e-4
    assert got.deviation.isna().all()            # beyond a long
    x = np.random.default_rng(3).integers(-1 << 46, 1 << 46, size=(500, 3))
    gram = whitening.exact_gram(x)
    rows = x.tolist()
    assert all(gram[i, j] == sum(r[i] * r[j] for r in rows) for i in range(3) for j in range(3))


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [5, 5, 5, 1, 1], [1 + 1e-9, 1, 1 - 1e-9, 0.5, 1e-6], [1, 1, 1, 1, 1],
    [2, 1 + 1e-13, 1, 1e-3, 0]])
def test_refinement_with_clusters(values):
    n = 12
    all_values = np.array((values * n)[:n], float) if len(set(values)) > 1 else np.ones(n)
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(3):      # orthogonal beyond double precision
        basis = basis @ (3 * np.eye(n, dtype=np.longdouble) - basis.T @ basis) / 2
    a = (basis * all_values) @ basis.T
    found, x = whitening.principal((a + a.T) / 2)
    assert np.abs(np.sort(found)[::-1] - np.sort(all_values)[::-1]).max() < 1e-16
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-17
    assert np.abs(a @ x - x * found).max() < 1e-16


def test_refinement_beats_single_precision():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(400, 40)) * np.linspace(1, 1.01, 40)
    a = (z.T @ z / 400).astype(np.longdouble)
    values, x = whitening.principal(a)
    _, start = np.linalg.eigh(a.astype(np.float32))
    start = start[:, ::-1].astype(np.longdouble)
    raw = np.abs(a @ start - start * (start * (a @ start)).sum(axis=0)).max()
    assert np.abs(a @ x - x * values).max() < 1e-16 < 1e-8 < raw


# --- 12: near vectors ---------------------------------------------------------------

def brute_links(rows, threshold=0.95):
    """By row: links, and the smallest id of the component."""
    unit = []
    for _, v in rows:
        good = v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)
        x = np.asarray(v, float) if good else None
        unit.append(x / np.linalg.norm(x) if good and np.abs(x).max() > 0 else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    group = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            least = min([group[i], *(group[j] for j in near[i])])
            changed |= least < group[i]
            group[i] = least
    ids = [min((rows[j][0] for j in range(n) if group[j] == group[i] and rows[j][0] is not None),
               default=None) for i in range(n)]
    return sorted(((r[0], len(near[i]), ids[i], r[0] == ids[i]) for i, r in enumerate(rows)), key=str)


def turned(u, angle, seed):
    away = np.random.default_rng(seed).normal(size=len(u))
    away -= away @ u * u
    return math.cos(angle) * u + math.sin(angle) * away / np.linalg.norm(away)


@pytest.fixture(scope="module")
def near_rows():
    base = vectors(5, 120).astype(float)
    rows = [*enumerate(base)]
    rows += [(200 + i, base[3]) for i in range(40)]                          # equal vectors
    rows += [(300 + i, turned(base[4] / np.linalg.norm(base[4]), 0.25, i)) for i in range(40)]
    step = turned(base[5], 1.5, 1)                                           # a chain of links
    rows += [(400 + i, math.cos(0.2 * i) * base[5] + math.sin(0.2 * i) * step) for i in range(12)]
    rows += [(3, base[3]), (3, base[9]), (None, base[10]), (None, base[11] * 3), (500, np.zeros(64))]
    rows += [(600 + i, v) for i, v in enumerate(ODD)] + [(700, [3.0, 4.0]), (701, [6.0, 8.0])]
    return [(i, v if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]


@pytest.mark.parametrize("shard_rows, block", [(16_384, 512), (60, 16)])
def test_links_and_components(spark, near_rows, shard_rows, block):
    df = spark.createDataFrame(near_rows, "vec_id long, embedding array<double>").withColumns(
        {c: F.lit("clash") for c in CLASH})
    got = neighbours.near_vectors(df, shard_rows=shard_rows, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(near_rows)


def test_near_vectors_without_links(spark):
    assert neighbours.near_vectors(table(spark, [])).count() == 0
    got = neighbours.near_vectors(table(spark, [(i, v) for i, v in enumerate(ODD)])).collect()
    assert sorted(map(tuple, got)) == [(i, 0, i, True) for i in range(5)]


def test_graph_finds_links_and_shares_nodes():
    x = vectors(6, 3000).astype(float)
    x = np.vstack([x, x[:1] + 0.01 * np.random.default_rng(1).normal(size=(500, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph.from_bytes(hnsw.build(np.arange(len(x)), x, 0.95).to_bytes())
    assert sorted(graph.rows) == list(range(len(x)))
    assert (graph.points == x[graph.rows]).all() and len(graph.heads) < 3100
    for links in graph.links:
        assert links.max() < len(links)
    q = np.array([turned(x[i], 0.3, i) for i in range(200)])
    found = {(a, graph.rows[b]) for who, at in graph.linked(q, 0.95, 32, True)
             for a, b in zip(who, at)}
    truth = set(zip(*np.nonzero(q @ x.T >= 0.95)))
    assert found <= truth and len(found) >= 0.99 * len(truth)


def test_audit_widens_beams(spark):
    units = neighbours.unit_vectors(table(spark, [*enumerate(vectors(8, 2000))]), "vec_id", "embedding")
    graphs, _ = neighbours.shard_graphs(units, 0.95, 1000)
    asked = neighbours.probes(units, 0.95, 64)
    assert neighbours.count_by_brute_force(units, asked, 0.95) >= 64
    size, recall = neighbours.audited_beam(units, graphs, 0.95, rows=64, size=1)
    assert recall >= neighbours.RECALL and size >= 1


# --- 13: centroid clusters ----------------------------------------------------------

def brute_clusters(rows, k=16, rounds=3):
    used = [(i, tuple(int(c) for c in whole(v))) for i, v in rows if v is not None and len(v) == 64
            and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(used, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    centroids = [x for _, x in order[:k]]
    def place():
        out = []
        for _, x in used:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        placed = place()
        for c in range(len(centroids)):
            mine = [x for (_, x), (p, _) in zip(used, placed) if p == c]
            if mine:
                centroids[c] = tuple(sum(column) // len(mine) for column in zip(*mine))
    placed = place()
    total = sum(d for _, d in placed)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, c, d, sum(e for p, e in placed if p == c), total, digest[c])
                  for (i, _), (c, d) in zip(used, placed))


@pytest.mark.parametrize("kind", ["spread", "grouped", "equal", "few"])
def test_clusters(spark, kind):
    x = vectors(9, 250)
    if kind == "grouped":
        x = vectors(10, 5)[np.arange(250) % 5] + 0.02 * vectors(11, 250)
    elif kind == "equal":
        x = np.repeat(vectors(12, 2), 125, axis=0)      # ties between centroids
    elif kind == "few":
        x = x[:6]
    rows = [*enumerate(x)] + [(3, x[3])] + [(1000 + i, v) for i, v in enumerate(ODD)] + [
        (2000, [1.0, 2.0])]
    got = simplex.cluster(table(spark, rows)).drop("compared")
    assert sorted(map(tuple, got.collect())) == brute_clusters(rows)


def test_clusters_of_nothing_and_of_large_numbers(spark):
    assert simplex.cluster(table(spark, [])).count() == 0
    assert simplex.cluster(table(spark, [(None, None), (1, [math.nan] * 64)])).count() == 0
    rows = [(i, [1e30 * (i % 2)] * 64) for i in range(4)] + [(None, [0.5] * 64)]
    assert simplex.cluster(table(spark, rows)).count() == 5


def test_projection_bounds_hold():
    x = whole(vectors(13, 400, scale=3.0))
    pivots = simplex.Simplex.over(np.vstack([x[:10], x[:2], (x[:1] + x[1:2]) // 2]))
    assert 8 <= len(pivots.pivots) <= 11
    a, b = x[:200], x[200:]
    low, high = simplex.bounds(*(pivots.apexes(pivots.squared(p)) for p in (a, b)))
    real = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert (low <= real + 1e-6).all() and (real <= high + 1e-6).all()


def test_projection_saves_comparisons(spark):
    x = vectors(14, 8)[np.arange(400) % 8] + 0.01 * vectors(15, 400)
    got = simplex.cluster(table(spark, [*enumerate(x)]), k=8)
    assert got.agg(F.avg("compared")).first()[0] < 4


# --- what operators share -----------------------------------------------------------

def test_tasks_follow_the_input_once_they_are_long(spark, tmp_path, monkeypatch):
    from docketry.llm import common

    path = str(tmp_path / "t")
    spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 512).alias("t")).repartition(
        40).write.parquet(path)
    df = spark.read.option("maxPartitionBytes", "64k").parquet(path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        most = common.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
        tasks = F.spark_partition_id().alias("p")
        assert common.few_files(df).select(tasks).distinct().count() <= most
        monkeypatch.setattr(common, "TASK_BYTES", 64 << 10)
        assert common.few_files(df, df).select(tasks).distinct().count() > most
    finally:
        spark.conf.set(key, before)


def test_own_names_avoid_every_case(spark):
    from docketry.llm.common import own_name

    df = spark.range(1).selectExpr("id as _ID", "id as `_id_1`")
    assert own_name(df, "_id") == "_id_2" and own_name(df, "x") == "x"


def test_topk_leaves_out_the_own_row_only(spark):
    """Two different vectors of one id are candidates of each other."""
    from docketry.llm import topk

    df = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [0.25, 0.0]),
                                (100, [0.0, 1.0]), (100, [0.0, 1.0])],
                               "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(
        df, df.filter("vec_id % 50 = 0"), 2).collect())
    one = 256 * 256
    assert got == sorted([
        (50, 1, 50, one // 2), (50, 2, 1, one // 4),          # of (1, 0)
        (50, 1, 50, one // 2), (50, 2, 100, one // 2),        # of (0.5, 0.5)
        (100, 1, 100, one), (100, 2, 50, one // 2)])
