import itertools
import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import models, ranking
from docketry.params import FAST, NORMAL, params


def results(spark, per_query):
    rows = [(q, f"u{q}-{i}", outcome, i + 1)
            for q, outcomes in enumerate(per_query) for i, outcome in enumerate(outcomes)]
    return spark.createDataFrame(
        rows, "query_id long, url string, outcome string, authority_rank int")


def test_modes():
    assert params() == NORMAL and params(fast=True) == FAST
    assert (NORMAL.stage1_top_k, NORMAL.stage2_top_k, NORMAL.pack_chars) == (40, 5, 32768)
    assert (FAST.stage1_top_k, FAST.stage2_top_k, FAST.pack_chars) == (20, 3, 8192)


def test_diversity(spark):
    cases = [["Allowed", "Dismissed"], ["Allowed", "Allowed"], ["Allowed", "Unknown"],
             ["Unknown", "Unknown"], ["Dismissed", "Unknown", "Dismissed"], ["Allowed"]]
    flags = ranking.outcome_diversity(results(spark, cases), spark.range(8).select(
        F.col("id").alias("query_id")))
    assert [r[1] for r in flags.orderBy("query_id").collect()] == [
        True, False, True, True, False, True, True, True]


def expected_landscape(outcomes):
    """Best of each side first, then unknown ones, then the rest; brute force."""
    roles = {"Allowed": "supportive", "Dismissed": "unsupportive", "Unknown": "context"}
    if len(outcomes) < 2:
        return [(i, "") for i in range(len(outcomes))]
    left = list(range(len(outcomes)))
    chosen = []
    for side in ("Allowed", "Dismissed"):
        best = next((i for i in left if outcomes[i] == side), None)
        if best is not None:
            left.remove(best)
            chosen.append(best)
    left.sort(key=lambda i: (outcomes[i] != "Unknown", i))
    return [(i, roles[outcomes[i]]) for i in (chosen + left)[:3]]


def test_landscape_over_all_outcomes(spark):
    kinds = ["Allowed", "Dismissed", "Unknown"]
    cases = [list(c) for n in range(1, 5) for c in itertools.product(kinds, repeat=n)]
    rows = ranking.landscape_select(results(spark, cases)).orderBy("query_id", "rank").collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append(
            (int(r["url"].split("-")[1]), r["landscape_role"]))
        assert r["rank"] == len(found[r["query_id"]])
    assert found == {q: expected_landscape(c) for q, c in enumerate(cases)}


def test_normal_mode_has_no_roles(spark):
    rows = ranking.assign_rank(results(spark, [["Allowed", "Dismissed"]]), False).collect()
    assert [(r["rank"], r["landscape_role"]) for r in rows] == [(1, ""), (2, "")]


def candidates(spark, n=60, queries=3):
    rng = random.Random(2)
    rows = [(q, f"u{i}", f"query {q}", "w " * rng.randint(1, 4), i + 1)
            for q in range(queries) for i in range(n)]
    return spark.createDataFrame(
        rows, "query_id long, url string, query string, packed string, stage1_rank int")


def by_length():
    return models.Scorer(python=lambda queries, docs: [len(d) / 10 for d in docs])


def test_rerank_is_stable(spark):
    df = candidates(spark)
    top = ranking.rerank_topk(df, by_length(), 5)
    assert "packed" not in top.columns
    scores = {(r["query_id"], r["url"]): len(r["packed"]) / 10 for r in df.collect()}
    for q in range(3):
        order = sorted(range(60), key=lambda i: -scores[(q, f"u{i}")])[:5]
        rows = top.filter(F.col("query_id") == q).orderBy("stage2_rank").collect()
        assert [r["url"] for r in rows] == [f"u{i}" for i in order]


def test_scorer_forms(spark):
    df = candidates(spark, 4, 1)
    column = models.Scorer(column=lambda q, d: F.length(d) / 10)
    pick = ["url", "reranker_score"]
    a, b = (models.score_pairs(df, s, "query", "packed").select(*pick) for s in (
        column, by_length()))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError):
        models.Scorer()
    short = models.Scorer(python=lambda q, d: [0.0] * (len(d) - 1))
    with pytest.raises(Exception, match="scores for"):
        models.score_pairs(df, short, "query", "packed").collect()


def test_lexical_overlap(spark):
    df = spark.createDataFrame(
        [("left my job", "I LEFT that job."), ("", "x"), ("a b", "c")], "q string, d string")
    out = models.score_pairs(df, models.lexical_overlap, "q", "d").collect()
    assert [r["reranker_score"] for r in out] == pytest.approx([2 / 3, 0.0, 0.0])


def test_authority_order_is_stable(spark):
    rows = [(1, "a", 0.5, "2026", "x", 1), (1, "b", 0.5, "2026", "x", 2),
            (1, "c", 0.9, "2005", "x", 3), (1, "d", 0.5, "2026", "section 1", 4)]
    df = spark.createDataFrame(rows, "query_id long, url string, reranker_score double,"
                                     " date string, text string, stage2_rank int")
    out = ranking.authority_rerank(df, as_of_year=2026).orderBy("authority_rank").collect()
    assert [r["url"] for r in out] == ["d", "a", "b", "c"]
