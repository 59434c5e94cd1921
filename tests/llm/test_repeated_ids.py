"""Rows that repeat an id but differ in text are judged by their own text."""

import pytest

from docketry.llm import decontaminate, simhash, similar

from .test_operators import words

SCHEMA = "doc_id long, text string"
A, B, C = words(1, 60), words(2, 60), words(3, 60)


@pytest.mark.parametrize("keep_one", [simhash.keep_one, similar.keep_one])
def test_near_duplicates(spark, keep_one):
    # 2 holds a copy of 1 and a text of its own; 3 holds two texts, one of them twice.
    rows = [(1, A), (2, A), (2, B), (3, B), (3, C), (3, C), (3, A.upper()), (None, A), (None, A)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts, "text")
        got = sorted((r.doc_id or 0, r.text) for r in keep_one(df).collect())
        assert got == sorted([(0, A), (0, A), (1, A), (2, B), (3, C)])


def test_decontamination(spark):
    df = spark.createDataFrame([(1, A), (1, B), (2, B + " " + A), (None, A), (None, B), (4, None)],
                               SCHEMA)
    items = spark.createDataFrame([(0, A)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.text or "") for r in decontaminate.without_leaks(
        df, items).collect())
    assert got == sorted([(1, B), (0, A), (0, B), (4, "")])


def test_substrings(spark):
    import corpus_pipeline as pipeline

    shared = words(9, 120)
    rows = [(1, f"{A} {shared}"), (2, f"{C} {C[:100]}"), (2, f"{shared} {B}"), (None, shared)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], SCHEMA + ", n_chars long")
    got = [(r.doc_id, r.text) for r in pipeline.substring_stage(spark, docs, "").collect()]
    assert len(got) == 4 and {rows[0], rows[1], rows[3]} < set(got)
    cut = next(t for i, t in got if i == 2 and t != rows[1][1])
    assert cut.endswith(B) and len(cut) < len(rows[2][1]) - 256
