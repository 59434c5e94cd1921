"""Plans have the shape the operators promise."""

import re

import pytest
from pyspark.sql import functions as F

from docketry.operators import dedupe, joins, sizes
from docketry.operators.vector_blocks import semantic_topk, semantic_topk_single

from .conftest import plan_of


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plans")
    spark.range(2000).select(
        F.col("id").alias("pos"), F.concat(F.lit("u"), "id").alias("url"),
        F.lit("n").alias("name"), F.lit("2020").alias("document_date"),
        F.repeat(F.lit("just cause "), 20).alias("text")).write.parquet(str(root / "d"))
    spark.range(2000).select(
        F.col("id").alias("pos"), F.concat(F.lit("u"), "id").alias("url"),
        F.array(*[(F.sin(F.col("id") * i)).cast("float") for i in range(1, 5)])
        .alias("embedding")).write.parquet(str(root / "v"))
    return spark.read.parquet(str(root / "d")), spark.read.parquet(str(root / "v"))


def schemas_read(plan):
    physical = plan[plan.index("== Physical Plan =="):]
    return re.findall(r"ReadSchema: struct<([^>]*>?[^>]*)>", physical)


def test_topk_limits_ahead_of_the_shuffle_and_reads_two_columns(tables):
    decisions, vectors = tables
    queries = vectors.select(F.col("pos").alias("query_id"), F.col("embedding").alias("q_vec"))
    plan = plan_of(semantic_topk(queries, vectors, 5))
    assert plan.count("WindowGroupLimit") >= 4
    (read,) = set(schemas_read(plan))
    assert "text" not in read and "pos" not in read
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_blocks_of_queries_copy_no_vectors(tables, monkeypatch):
    from docketry.operators import vector_blocks as blocks

    decisions, vectors = tables
    queries = vectors.select(F.col("pos").alias("query_id"), F.col("embedding").alias("q_vec"))
    seen = []
    vectors_scan = blocks._broadcast_hits

    def scan(head, df, k):
        seen.append(vectors_scan(head, df, k))
        return seen[-1]

    monkeypatch.setattr(blocks, "_broadcast_hits", scan)
    hits = semantic_topk(queries, vectors, 5, max_broadcast_queries=700, first_slice=100)
    assert hits.count() == 5 * 2000 and len(seen) == 6      # three blocks, a sample and all
    for plan in [plan_of(hits), *map(plan_of, seen)]:
        assert "Generate" not in plan and "explode" not in plan and "Exchange" not in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_single_query_keeps_a_heap_not_a_sort(tables):
    plan = plan_of(semantic_topk_single(tables[1], [1.0, 0.0, 0.0, 0.0], 3))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_dedupe_limits_ahead_of_the_shuffle(tables):
    plan = plan_of(dedupe.dedupe_keep_first(tables[1], "url"))
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("WindowGroupLimit") == 2


def test_glossary_is_broadcast(tables):
    assert "BroadcastHashJoin" in plan_of(joins.document_terms(tables[0]))


def test_aligning_does_not_read_texts(tables):
    plan = plan_of(joins.align(*tables, check=False))
    assert all("text" not in s for s in schemas_read(plan))


def test_hit_documents_filter_where_texts_are_read(tables, spark):
    hits = spark.createDataFrame([(1, "u5", 0.5, 1)], "query_id long, url string,"
                                                      " stage1_score double, stage1_rank int")
    plan = plan_of(joins.hit_documents(hits, tables[0]))
    physical = plan[plan.index("== Physical Plan =="):]
    assert "BroadcastHashJoin" in physical and "SortMergeJoin" not in physical


def test_large_sides_are_not_broadcast(tables):
    decisions, vectors = tables
    small = sizes.broadcast_within(decisions.select("url"))
    large = sizes.broadcast_within(decisions.select("url"), max_bytes=1000)
    assert "strategy=broadcast" in plan_of(small)
    assert "strategy=broadcast" not in plan_of(large)


def test_measured_size_counts_text_and_elements(spark):
    df = spark.createDataFrame([("abé", ["xy", "z"], [1.0]), (None, None, None)],
                               "s string, a array<string>, f array<float>")
    assert sizes.measured_bytes(df) == 2 * 48 + 4 + 32 + 3 + 16


def moved(plan, column):
    """Whether an exchange or a sort of the plan carries a column."""
    physical = plan[plan.index("== Physical Plan =="):].split("\n")
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in physical]
    for i, line in enumerate(physical):
        if re.search(r"(Exchange|Sort|Window) ?[\[(h]", line) and "Broadcast" not in line:
            below = next((physical[j] for j in range(i + 1, len(physical)) if depth[j] > depth[i]), "")
            if re.search(rf"\b{column}#\d+", line + below):
                return True
    return False


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("results") / "r")
    spark.range(400).select(
        (F.col("id") / 4).cast("long").alias("query_id"), (F.col("id") % 4 + 1).cast("int").alias("rank"),
        F.concat(F.lit("u"), F.col("id") % 50).alias("url"), F.lit("n").alias("name"),
        F.lit("2020").alias("date"), (F.col("id") % 7 / 7).alias("authority_score"),
        F.concat(F.lit("text of "), F.col("id") % 50).alias("full_text")).write.parquet(path)
    return spark.read.parquet(path)


def test_cards_move_no_texts(results):
    from docketry.operators.models import generate_cards
    from docketry.plans.search import top_cards

    def write(prompts):
        return ["**Issue:**\n- " + str(len(p)) for p in prompts]

    for generator in (None, write):
        for df in (generate_cards(results, generator), top_cards(results, generator)):
            assert not moved(plan_of(df), "full_text") and not moved(plan_of(df), "text")
            assert "Window" not in plan_of(df)
    assert generate_cards(results).count() == 50
    assert top_cards(results).count() == 100
    shuffled = results.repartition(3, "url")
    assert moved(plan_of(shuffled), "full_text")


def test_cards_of_rows_alike(spark):
    """Rows that agree in all narrow columns, and documents with several texts."""
    from docketry.operators.models import generate_cards

    rows = [("u1", "n", "d", "one")] * 3 + [("u1", "n", "d", "two"), (None, "n", "d", "three"),
                                            (None, "n", "d", "four"), (None, "n", "d", None)]
    df = spark.createDataFrame(rows, "url string, name string, date string, full_text string")
    cards = generate_cards(df, lambda prompts: [p[-120:] for p in prompts]).collect()
    assert len(cards) == 4 and len({c["document"] for c in cards}) == 4


def test_a_card_limit_reaches_the_generator(results):
    from docketry.operators.models import generate_cards

    def write(prompts, max_tokens):
        return [f"**Issue:**\n- {max_tokens}" for _ in prompts]

    cards = generate_cards(results, write, max_tokens=768).collect()
    assert len(cards) == 50 and all("768" in c["card"] for c in cards)
