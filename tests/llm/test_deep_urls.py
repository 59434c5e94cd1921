"""Urls that differ only far down their paths."""

from docketry.llm import urls


def test_deep_branches_have_their_own_verdict(spark):
    deep = "a/b/c/d/e/f/g/h"
    rows = [f"http://h.net/{deep}/{kind}/{n}/x" for kind in ("spam", "news") for n in range(100, 300)]
    rows += ["http://h.net/" + "/".join("pqrs"[i % 4] for i in range(500)), "http://h.net/"]
    rules = [("block", f"h.net/{deep}/spam/1"), ("allow", f"h.net/{deep}/news/1")]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r.page_id]: r for r in urls.judge(df, rules).collect()}
    assert len(got) == len(rows)
    for n in range(200, 300):
        for kind, verdict in (("spam", "block"), ("news", "allow")):
            row = got[f"http://h.net/{deep}/{kind}/{n}/x"]
            assert row.verdict == verdict and row.rule is None


def test_trees_reach_every_segment(spark):
    rows = [("h", [*"abcdefg", *tail], 1, 0, 0) for tail in (["x"], ["x", "y"], ["x", "y", "z"], [])]
    rows += [("h", [], 1, 0, 0), ("i", list("abcdefghijk"), 3, 1, 0)]
    got = {(r.host, tuple(r.template)): tuple(r.tree) for r in urls.grow(spark.createDataFrame(
        rows, "host string, template array<string>, n long, good long, bad long")).collect()}
    assert got == {(h, tuple(t)): tuple(t) for h, t, *_ in rows}
