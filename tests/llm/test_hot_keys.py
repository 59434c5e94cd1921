"""Keys that a large part of the rows share."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from docketry.llm import common, simhash, warc
from docketry.llm.common import join_spread, passing, scratch, written
from docketry.llm.components import connected
from docketry.session import checkpoint_dir


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [1, 5, 10 ** 6])
def test_joined_as_by_a_plain_join(spark, monkeypatch, how, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(
        F.col("id") % 50).alias("k"))
    keyed = rows.filter("k < 40").groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    got = join_spread(rows, keyed, "k", "n", how)
    want = rows.join(keyed.drop("n"), "k", how)
    assert got.columns == ["k", "id", "most"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert join_spread(rows.limit(0), keyed.limit(0), "k", "n", how).collect() == []


def test_copies_of_one_text_are_in_no_shuffle(spark):
    rows = written(spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(
        F.col("id")).alias("k"), "id"), "rows")
    keyed = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "keyed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = join_spread(rows, keyed, "k", "n")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hot, rest = plan.split("LeftAnti")[0], plan
    assert "BroadcastHashJoin" in hot and "SortMergeJoin" in rest
    assert rest.index("SortMergeJoin") < rest.index("LeftAnti")


def test_one_payload_and_one_text_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    html = ["<p>" + "x" * 1200 if i % 3 else f"<p>{i}" + "y" * (i % 7 * 300) for i in range(60)]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)],
                               "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(df, path)
    got = {r.page_id: r for r in warc.captures(spark, path).collect()}
    assert len(got) == 60
    for i, h in enumerate(html):
        last = max(j for j, o in enumerate(html) if o == h)
        first = len(h) < 1000 or last == i
        assert got[i].payload_digest == hashlib.sha1(h.encode()).hexdigest()
        assert (got[i].record_type, got[i].refers_to) == (
            ("response", None) if first else ("revisit", last))
    docs = spark.createDataFrame([(i, h + " a b c") for i, h in enumerate(html)], "doc_id long, text string")
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(found) == 60
    for i, h in enumerate(html):
        alike = [j for j in found if bin(int(found[i].fingerprint, 16) ^ int(
            found[j].fingerprint, 16)).count("1") <= 3]
        assert found[i].component_id <= min(alike)
        assert {found[j].component_id for j in alike} == {found[i].component_id}


def tables(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    return set(os.listdir(folder))


@pytest.mark.parametrize("share", [1, 1024])
def test_hubs_and_chains(spark, monkeypatch, share):
    """A hub of most links, a chain, repeated links, links either way, and null ends."""
    monkeypatch.setattr(common, "HOT_SHARE", share)
    pairs = [(500, i) for i in range(501, 900)] + [(i + 1, i) for i in range(20, 60)]
    pairs += [(3, 3), (7, 8), (8, 7), (7, 8), (None, 1), (2, None), (899, 41), (950, 951)]
    group = {}
    for a, b in (p for p in pairs if None not in p and p[0] != p[1]):
        x, y = group.setdefault(a, a), group.setdefault(b, b)
        group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    before = tables(spark)
    got = connected(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(group) and {r.node: r.root for r in got} == group
    # What a round alone needs is gone; each round's links stay for the table that was returned.
    left = tables(spark) - before
    assert left and all(name.startswith("edges-") for name in left)
    assert connected(spark.createDataFrame([(5, 5), (None, 1)], "a long, b long")) is None


def test_tables_inside_a_block_are_deleted(spark):
    before = tables(spark)
    with passing(spark):
        first = written(spark.range(10), "first")
        with passing(spark):
            second = written(first.filter("id > 3"), "second")
            third = written(second.filter("id > 5"), "third", kept=True)
        assert {n.split("-")[0] for n in tables(spark) - before} == {"first", "third"}
        last = written(third.filter("id > 7"), "last", kept=True)
    assert {n.split("-")[0] for n in tables(spark) - before} == {"last"}
    assert sorted(r.id for r in last.collect()) == [8, 9]
    with pytest.raises(ZeroDivisionError):
        with passing(spark):
            written(spark.range(3), "broken")
            raise ZeroDivisionError
    assert {n.split("-")[0] for n in tables(spark) - before} == {"last"}
