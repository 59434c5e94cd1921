import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.functions import vectors as V
from docketry.operators.profiles import embedding_profile, vector_quality
from docketry.operators.vector_blocks import (PARTIAL_ROWS, QUERY_BYTES, broadcast_queries,
                                              growing_slices, prepare_vectors, scan_tasks,
                                              semantic_topk, semantic_topk_single)

NAN, INF = float("nan"), float("inf")
CASES = [[3.0, 4.0, 0.0], [NAN, 2.0, 1.0], [INF, -INF, 5.0], [0.0, 0.0, 0.0],
         [1e20, 1e20, 0.0], [300.0, 400.0, 500.0], [-1.0, 0.0, 0.0]]


def same(a, b):
    return np.allclose(np.array(a), np.array(b), rtol=1e-6, atol=0)


def test_sanitize_rows_zeroes_the_whole_vector(one):
    out = one(V.sanitize_rows, CASES, "array<float>")
    assert out[1] == out[2] == [0.0] * 3
    assert all(same(out[i], CASES[i]) for i in (0, 3, 4, 5, 6))


def test_sanitize_values_zeroes_single_elements(one):
    out = one(V.sanitize_values, CASES, "array<float>")
    assert out[1] == [0.0, 2.0, 1.0] and out[2] == [0.0, 0.0, 5.0] and same(out[0], CASES[0])


def test_normalize_gives_length_one_or_zero(one):
    out = one(V.sanitize_and_normalize, CASES, "array<float>")
    assert same(out[0], [0.6, 0.8, 0.0]) and same(out[2], [0.0, 0.0, 1.0])
    assert out[3] == [0.0] * 3
    for vec in out:
        assert math.isclose(np.linalg.norm(vec), 1.0, rel_tol=1e-6) or not any(vec)


def test_block_form_equals_column_form(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(CASES)], "i int, v array<float>")
    columns = df.select("i", V.sanitize_and_normalize(F.col("v")).alias("v"))
    blocks = prepare_vectors(df, "v")
    assert blocks.schema == df.schema
    assert sorted(map(tuple, columns.collect())) == sorted(map(tuple, blocks.collect()))


def test_scores(spark, one):
    assert one(V.clamp_score, [NAN, INF, -INF, 0.5], "double") == [-1.0, -1.0, -1.0, 0.5]
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "a array<float>, b array<float>")
    assert df.select(V.dot(F.col("a"), F.col("b"))).first()[0] == 1.0
    p = spark.range(1).select(*[V.yes_no_probability(F.lit(y), F.lit(n)) for y, n in (
        (0.0, 0.0), (2.0, 0.0), (-800.0, 800.0), (800.0, -800.0))]).first()
    assert p[0] == 0.5 and math.isclose(p[1], 1 / (1 + math.exp(-2)))
    assert p[2] == 0.0 and p[3] == 1.0


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0]), (0, [3.0, -4.0]), (2, [1e-35, 0.0])], "pos long, embedding array<float>")
    row = embedding_profile(df).first()
    assert (row["n_rows"], row["dim"], row["max"], row["min"]) == (3, 2, 3.0, -4.0)
    assert math.isclose(row["mean"], 2 / 6) and row["n_tiny"] == 1
    assert not row["any_nan"] and not row["any_inf"]
    assert row["first_norms"] == pytest.approx([5.0, math.sqrt(5), 1e-35])
    bad = spark.createDataFrame([(0, [NAN, 1.0]), (1, [INF, -INF])],
                                "pos long, embedding array<float>")
    row = embedding_profile(bad).first()
    assert row["any_nan"] and row["any_inf"] and math.isnan(row["max"]) and math.isnan(row["min"])
    assert tuple(vector_quality(bad).first()) == (3, 2)


# --- top-k against brute force -------------------------------------------------------

def frames(spark, docs, queries, partitions=5):
    vectors = spark.createDataFrame(
        [(u, [float(x) for x in v]) for u, v in docs], "url string, embedding array<float>")
    asked = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(queries)],
        "query_id long, q_vec array<float>")
    return asked, vectors.repartition(partitions)


def unit(v):
    v = np.nan_to_num(np.asarray(v, np.float32), nan=0.0, posinf=0.0, neginf=0.0)
    wide = v.astype(np.float64)
    return (wide / max(np.sqrt((wide * wide).sum()), 1e-12)).astype(np.float32).astype(float)


def brute(docs, queries, k):
    expected = {}
    for i, query in enumerate(queries):
        scored = [(-round(float(unit(v) @ unit(query)), 9) + 0.0, u) for u, v in docs]
        expected[i] = [(u, -s) for s, u in sorted(scored)[:k]]
    return expected


def collected(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["stage1_rank"])):
        out.setdefault(r["query_id"], []).append((r["url"], r["stage1_score"]))
        assert len(out[r["query_id"]]) == r["stage1_rank"]
    return out


def check(found, expected):
    assert found.keys() == expected.keys()
    for i in expected:
        assert [u for u, _ in found[i]] == [u for u, _ in expected[i]]
        assert np.allclose([s for _, s in found[i]], [s for _, s in expected[i]], atol=1e-9)


@pytest.mark.parametrize("options", [{}, {"max_broadcast_queries": 3, "first_slice": 10}])
def test_topk_equals_brute_force(spark, options):
    rng = np.random.default_rng(3)
    # A third of all vectors are copies of one, so ties cross every partition.
    docs = [(f"d{i:03}", rng.normal(size=8)) for i in range(200)]
    docs += [(f"c{i:03}", docs[0][1]) for i in range(100)]
    queries = [docs[0][1], *rng.normal(size=(10, 8)), np.zeros(8)]
    asked, vectors = frames(spark, docs, queries)
    for k in (1, 7, 40, 400):
        check(collected(semantic_topk(asked, vectors, k, **options)), brute(docs, queries, k))


@pytest.mark.parametrize("options", [{}, {"max_broadcast_queries": 3, "first_slice": 10}])
def test_a_seed_changes_nothing(spark, options):
    rng = np.random.default_rng(8)
    docs = [(f"d{i:03}", rng.normal(size=8)) for i in range(150)]
    docs += [(f"c{i:03}", docs[0][1]) for i in range(50)]
    queries = [docs[0][1], *rng.normal(size=(6, 8))]
    asked, vectors = frames(spark, docs, queries)
    for prefix in ("d", "c", "d00", "none"):
        seed = vectors.filter(F.col("url").startswith(prefix))
        check(collected(semantic_topk(asked, vectors, 12, seed=seed, **options)),
              brute(docs, queries, 12))


@pytest.mark.parametrize("sizes", [(32_768, 1 << 20, 2_000_000), (2, 90, 50)])
def test_many_blocks_are_searched_in_one_job(spark, monkeypatch, sizes):
    from docketry.operators import vector_blocks

    for name, value in zip(("CELL_QUERIES", "CELL_VECTORS", "CELL_HITS"), sizes):
        monkeypatch.setattr(vector_blocks, name, value)
    scans = []
    scan = vector_blocks._broadcast_hits
    monkeypatch.setattr(vector_blocks, "_broadcast_hits", lambda *a: scans.append(a) or scan(*a))
    rng = np.random.default_rng(4)
    docs = [(f"d{i:04}", rng.normal(size=8)) for i in range(1500)]
    docs += [(f"c{i:03}", docs[0][1]) for i in range(100)]
    queries = [docs[0][1], *rng.normal(size=(20, 8)), np.zeros(8)]
    asked, vectors = frames(spark, docs, queries)
    hits = semantic_topk(asked, vectors, 7, max_broadcast_queries=2)
    check(collected(hits), brute(docs, queries, 7))
    assert not scans


def test_a_task_merges_seldom_and_keeps_the_best(monkeypatch):
    """Hits wait for a merge until the rows double; ties go by url in whatever order they come."""
    from docketry.operators import vector_blocks as B
    rng = np.random.default_rng(5)
    docs = rng.integers(-3, 4, (12_000, 6)).astype(np.float32)
    asked = rng.integers(-3, 4, (500, 6)).astype(np.float32)
    urls = np.array([f"u{i:05d}" for i in rng.permutation(len(docs))])
    merges, merge = [], B._TopK._merge
    monkeypatch.setattr(B._TopK, "_merge", lambda top: (merges.append(1), merge(top))[1])
    top = B._TopK(np.arange(500), asked, 7, np.full(500, -np.inf))
    for at in range(0, len(docs), 300):
        top.add(pa.array(urls[at:at + 300]), docs[at:at + 300])
    found = top.hits()
    assert len(merges) < 12
    a, b = B._prepare(asked).astype(np.float64), B._prepare(docs).astype(np.float64)
    scores = np.round(a @ b.T, 9)
    rows = found.to_pylist()
    for q in range(500):
        best = np.lexsort((urls, -scores[q]))[:7]
        got = [r for r in rows if r["query_id"] == q]
        assert [r["url"] for r in got] == urls[best].tolist()
        assert np.allclose([r["stage1_score"] for r in got], scores[q][best], atol=2e-9)


def test_bad_values_in_query_and_documents(spark):
    docs = [("a", [1.0, 0.0]), ("b", [INF, 1.0]), ("c", [0.0, NAN])]
    asked, vectors = frames(spark, docs, [[INF, NAN]])
    hits = semantic_topk(asked, vectors, 2).collect()
    assert len(hits) == 2 and all(math.isfinite(r["stage1_score"]) for r in hits)
    assert [r["url"] for r in sorted(hits, key=lambda r: r["stage1_rank"])] == ["a", "b"]


def test_topk_of_nothing(spark):
    asked, vectors = frames(spark, [("a", [1.0])], [[1.0]])
    assert semantic_topk(asked, vectors.filter("false"), 3).count() == 0
    assert semantic_topk(asked.filter("false"), vectors, 3).count() == 0


@pytest.mark.parametrize("width", [0, 1, 64, 4096, 1 << 20, 1 << 30])
def test_blocks_are_bounded_in_bytes(width):
    queries = broadcast_queries(width)
    assert queries == 1 or 1 < queries and queries * width * 8 <= QUERY_BYTES


def test_samples_grow_and_hold_each_other(spark):
    docs = [(f"d{i}", [1.0]) for i in range(3000)]
    _, vectors = frames(spark, docs, [[1.0]])
    found = [{r["url"] for r in s.collect()} for s in growing_slices(vectors, 10)]
    assert len(found) == 2 and found[0] < found[1]
    assert 2 <= len(found[0]) <= 30 and 100 <= len(found[1]) <= 230


def test_partial_rows_do_not_grow_with_the_store():
    tasks = scan_tasks(4096, 40, 4000)
    assert tasks == 8000                          # all cores have work
    assert scan_tasks(1, 40, 8) * 40 <= PARTIAL_ROWS
    assert scan_tasks(0, 40, 8) > 8


def test_a_scan_of_many_splits_is_joined(spark, monkeypatch):
    from docketry.operators import vector_blocks

    monkeypatch.setattr(vector_blocks, "scan_tasks", lambda *_: 2)
    rng = np.random.default_rng(9)
    docs = [(f"d{i}", rng.normal(size=4)) for i in range(60)]
    asked, vectors = frames(spark, docs, [docs[0][1]])
    spread = vectors.repartition(12)
    head = asked.withColumn("floor", F.lit(None).cast("double")).toArrow()
    assert vector_blocks._broadcast_hits(head, spread, 5).rdd.getNumPartitions() == 2
    check(collected(semantic_topk(asked, spread, 5)), brute(docs, [docs[0][1]], 5))


def test_unequal_lengths_are_refused(spark):
    asked, vectors = frames(spark, [("a", [1.0, 2.0]), ("b", [1.0])], [[1.0, 1.0]], 1)
    with pytest.raises(Exception, match="unequal length"):
        semantic_topk(asked, vectors, 1).collect()


def test_single_query_form_agrees(spark):
    rng = np.random.default_rng(5)
    docs = [(f"d{i}", rng.normal(size=6)) for i in range(50)]
    query = rng.normal(size=6)
    asked, vectors = frames(spark, docs, [query])
    single = semantic_topk_single(vectors, list(query), 9).collect()
    assert [(r["url"], r["stage1_score"]) for r in single] == collected(
        semantic_topk(asked, vectors, 9))[0]
