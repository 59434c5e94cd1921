import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import models
from docketry.params import FAST, NORMAL
from docketry.operators.joins import hit_documents
from docketry.plans import search as S
from docketry.schemas import RESULT_COLUMNS
from docketry.sources.decisions import write_bucketed

from .conftest import plan_of

QUERIES = ["left my job", "pension and disability", "late application for benefits"]
OUTCOMES = ["allowed", "dismissed", "considered"]


@pytest.fixture(scope="module")
def world(spark):
    words = ["job", "left", "pension", "disability", "late", "benefits", "work", "application"]
    rows = []
    for i in range(60):
        body = " ".join(words[(i * j) % 8] for j in range(1, 2 + i % 7))
        text = (f"Decision Content\nDecision [1] The appeal is {OUTCOMES[i % 3]}.\n"
                f"Analysis [2] {body}. [3] I find so. [4] Therefore.")
        rows.append((i, f"u{i}", f"n{i}", f"{2026 - i % 20}-01-01", text))
    decisions = spark.createDataFrame(
        rows, "pos long, url string, name string, document_date string, text string"
    ).repartition(3).cache()
    encoder = models.hashed_terms(16)
    vectors = models.encode(decisions, encoder, keep=["pos", "url"]).cache()
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    return queries, decisions, vectors, encoder


def run(world, params=NORMAL, queries=None, **options):
    asked, decisions, vectors, encoder = world
    return S.search(queries if queries is not None else asked, decisions, vectors,
                    params=params, encoder=encoder, as_of_year=2026, **options)


def test_normal_search(world):
    out = run(world)
    assert out.results.columns == RESULT_COLUMNS
    rows = out.results.orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"]) for r in rows] == [
        (q, n) for q in range(3) for n in range(1, 6)]
    for r in rows:
        assert r["authority_score"] <= r["reranker_score"] <= 1
        assert r["snippet"] == r["full_text"][:500] and r["landscape_role"] == ""
    for a, b in zip(rows, rows[1:]):
        assert a["query_id"] != b["query_id"] or a["authority_score"] >= b["authority_score"]
    assert [tuple(r)[1:3] for r in out.summary.orderBy("query_id").collect()] == [("ok", 40)] * 3
    assert out.summary.filter("landscape_mode").count() == 0


def test_fast_search_shows_both_sides(world):
    out = run(world, FAST)
    by_query = {}
    for r in out.results.orderBy("query_id", "rank").collect():
        by_query.setdefault(r["query_id"], []).append(r)
    for rows in by_query.values():
        assert len(rows) <= 3 and all(r["landscape_role"] for r in rows)
        order = [r["landscape_role"] for r in rows]
        if "supportive" in order:
            assert order[0] == "supportive"
    assert out.summary.filter("landscape_mode").count() == 3


def test_one_query_at_a_time_gives_the_same(world):
    many = {}
    for r in run(world, FAST).results.collect():
        many.setdefault(r["query_id"], []).append(r)
    for q in range(3):
        alone = run(world, FAST, world[0].filter(F.col("query_id") == q)).results.collect()
        assert sorted(alone) == sorted(many[q])


def test_the_shuffled_joins_give_the_same(world, monkeypatch):
    """With nothing small enough to broadcast, the results do not change."""
    expected = sorted(run(world).results.collect())
    from docketry.operators import sizes

    monkeypatch.setattr(sizes.broadcast_within, "__defaults__", (-1, None))
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    assert sorted(run(world).results.collect()) == expected


def test_buckets_and_seed_give_the_same(world, tmp_path, spark):
    queries, decisions, vectors, encoder = world
    expected = sorted(run(world).results.collect())
    path = str(tmp_path / "corpus")
    write_bucketed(decisions, path, 16)
    laid_out = spark.read.parquet(path)
    out = S.search(queries, laid_out, vectors, encoder=encoder, as_of_year=2026, buckets=16,
                   seed=vectors.filter("pos < 20"))
    assert sorted(out.results.collect()) == expected
    one = spark.createDataFrame([("u7",)], "url string")
    found = hit_documents(one, laid_out, 16)
    assert [r["url"] for r in found.collect()] == ["u7"]
    assert re.search(r"PartitionFilters: \[[^]]*url_bucket", plan_of(found))


def test_python_scorer(world):
    scorer = models.Scorer(python=lambda queries, docs: [1 / (1 + len(d)) for d in docs])
    rows = run(world, scorer=scorer).results.collect()
    assert len(rows) == 15 and all(r["relevance_label"] == "Low" for r in rows)


def test_copies_of_a_decision_count_once(world):
    """One url holds a third of the corpus; its first row is the one that counts."""
    queries, decisions, vectors, encoder = world
    expected = sorted(run(world).results.collect())
    copies = decisions.filter("url = 'u7'").select(
        F.explode(F.expr("sequence(1000L, 1030L)")).alias("pos"), "url", "name",
        "document_date", F.lit("another text").alias("text"))
    out = S.search(queries, decisions.unionByName(copies), vectors, encoder=encoder,
                   as_of_year=2026)
    assert sorted(out.results.collect()) == expected


def test_without_vectors_there_is_a_status(world):
    queries, decisions, vectors, encoder = world
    out = S.search(queries, decisions, vectors.filter("false"), encoder=encoder)
    assert out.results.count() == 0
    assert {tuple(r)[1:] for r in out.summary.collect()} == {("no_candidates", 0, True, False)}
    message = out.summary.select(S.status_message(F.col("status"))).first()[0]
    assert message == "No similar cases were found for this query."


def test_hits_without_documents_are_none_after_rerank(world):
    queries, decisions, vectors, encoder = world
    out = S.search(queries, decisions.filter("false"), vectors, encoder=encoder)
    assert {r["status"] for r in out.summary.collect()} == {"none_after_rerank"}


def test_cards_for_the_best_by_authority(world, spark):
    results = run(world, FAST).results
    best = {}
    for r in results.collect():
        if r["query_id"] not in best or r["authority_score"] > best[r["query_id"]][0]:
            best[r["query_id"]] = (r["authority_score"], r["url"])
    calls = spark.sparkContext.accumulator(0)

    def generator(prompts):
        calls.add(len(prompts))
        return [f"<think>x</think>hi **Issue:** {len(p)}" for p in prompts]

    cards = S.top_cards(results, generator, max_chars=FAST.generation_max_chars).collect()
    assert {r["query_id"]: r["url"] for r in cards} == {q: u for q, (_, u) in best.items()}
    assert all(r["card"].startswith("**Issue:** ") for r in cards)
    assert calls.value == len({u for _, u in best.values()})
    stand_in = S.top_cards(results, grounded=True).collect()
    assert all("[Source: para 2-4 | explicit]" in r["card"] for r in stand_in)


def test_given_query_vectors_need_no_encoder(world, spark):
    queries, decisions, vectors, encoder = world
    asked = spark.createDataFrame(
        [(0, QUERIES[0], [float(x) for x in np.ones(16)])],
        "query_id long, query string, q_vec array<float>")
    assert S.search(asked, decisions, vectors, as_of_year=2026).results.count() == 5


@pytest.mark.parametrize("name", ["search_summary", "search_seeded", "search_statuses"])
def test_document_vectors_are_computed_once(spark, monkeypatch, tmp_path, name):
    """What a query hands to the search is written; passing it again encodes no text."""
    from catalog import queries as Q
    spark.createDataFrame([(i, f"the appeal of case {i} is allowed", "s") for i in range(12)],
                          "doc_id long, text string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "appeal of case 3")],
                          "conv_id long, turn int, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)],
                          "vec_id long, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    given, whole = [], Q.search.search

    def spy(queries, decisions, vectors, **options):
        given.extend(v for v in (vectors, options.get("seed")) if v is not None)
        return whole(queries, decisions, vectors, **options)

    monkeypatch.setattr(Q.search, "search", spy)
    assert Q.QUERIES[name](spark, str(tmp_path)).count() > 0
    assert given
    for vectors in given:
        assert "MapInArrow" not in vectors._jdf.queryExecution().toString()
