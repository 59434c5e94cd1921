"""The tree of path templates against a recursive one, and how verdicts back off."""

import math
import random
from collections import defaultdict

import pytest

from docketry.llm import urls

SHAPES = "host string, template array<string>, n long, good long, bad long"


def plain_tree(rows):
    """{(host, template): (tree, purity)} by recursion over each host's templates."""
    labels = sum(g + b for _, _, _, g, b in rows)
    share = sum(b for *_, b in rows) / labels if labels else 0.0
    out = {}

    def purity(part, towards):
        bad, all_ = sum(b for *_, b in part), sum(g + b for *_, g, b in part)
        return None if towards is None else (bad + urls.STRENGTH * towards) / (all_ + urls.STRENGTH)

    def visit(host, part, tree, own):
        depth = len(tree)
        ends = [r for r in part if len(r[0]) == depth]
        more = [r for r in part if len(r[0]) > depth]
        at_end = own if not more else purity(ends, own)
        for r in ends:
            out[host, tuple(r[0])] = (tree, at_end)
        kids = defaultdict(list)
        for r in more:
            kids[r[0][depth]].append(r)
        bad_all, all_all = sum(b for *_, b in more), sum(g + b for *_, g, b in more)
        groups = defaultdict(list)
        for seg, kid in kids.items():
            n = sum(r[1] for r in more)
            variable = len(kids) > urls.MANY and len(kids) * urls.FEW_URLS > n
            bad, some = sum(b for *_, b in kid), sum(g + b for *_, g, b in kid)
            rest = all_all - some
            plain = len(kids) == 1
            if some and rest and 0 < bad_all < all_all:
                p = bad_all / all_all
                z = abs(bad / some - (bad_all - bad) / rest) / math.sqrt(p * (1 - p) * (1 / some + 1 / rest))
                plain = plain or z >= urls.Z
            groups[seg if plain and not variable else "*"] += kid
        for name, kid in groups.items():
            below = own if len(kid) == len(part) else purity(kid, own)
            if len(kid) == 1:
                out[host, tuple(kid[0][0])] = ((*tree, name, *kid[0][0][depth + 1:]), below)
            else:
                visit(host, kid, (*tree, name), below)

    hosts = defaultdict(list)
    for host, *r in rows:
        hosts[host].append(r)
    for host, part in hosts.items():
        visit(host, part, (), purity(part, share if sum(g + b for *_, g, b in part) else None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_and_purity_are_those_of_recursion(spark, seed):
    rng = random.Random(seed)
    seen = {}
    for host, kinds, deepest in (("a", "xyz", 4), ("b", "pq", 7), ("c", "abcdefghijklmnopqrstuvwxyz", 2)):
        for _ in range(150):
            parts = rng.choices(kinds, k=rng.randint(0, deepest))
            if rng.random() < 0.3:
                parts = [*"long", *parts]
            spam = host != "c" and parts[:1] in (["x"], ["p"])
            good, bad = rng.choice([(0, 0), (0, 0), (0, 6) if spam else (5, 0), (1, 1)])
            seen[host, tuple(parts)] = (rng.randint(1, 9) + good + bad, good, bad)
    seen["none", ("u",)] = seen["none", ()] = (3, 0, 0)
    seen["deep", ("s",) * 300] = (1, 0, 1)
    seen["deep", (*["s"] * 299, "t")] = (1, 0, 0)
    rows = [(h, list(t), *v) for (h, t), v in seen.items()]
    want = plain_tree(rows)
    assert len({tree for tree, _ in want.values()}) > 30 and any("*" in t for t, _ in want.values())
    found = urls.template_purity(spark.createDataFrame(rows, SHAPES)).collect()
    assert len(found) == len(rows)
    for r in found:
        tree, share = want[r.host, tuple(r.template)]
        assert tuple(r.tree) == tree
        assert r.purity == (share if share is None else pytest.approx(share, rel=1e-12))


def test_templates_without_labels_follow_their_branch(spark):
    rules = [("block", "h.net/spam/a"), ("allow", "h.net/news/a"), ("block", "bad.net/x/a")]
    rows = [f"http://h.net/{kind}/{tail}/{k}" for kind in ("spam", "news")
            for tail in ("alpha", "above", "other") for k in "klm" for _ in range(5)]
    rows += [f"http://bad.net/{kind}" for kind in ("x/ab", "x/ac", "x/ad", "y") for _ in range(9)]
    rows += ["http://free.net/spam/other/k", "http://bad.net/x/a" + "/s" * 5000]
    got = defaultdict(set)
    df = spark.createDataFrame([(i % 7, u) for i, u in enumerate(rows)], "page_id long, url string")
    for r in urls.judge(df, rules).collect():
        got[r.host, r.path, r.rule is None].add(r.verdict)
    assert got["h.net", "/spam/other/k", True] == {"block"}       # its branch
    assert got["h.net", "/news/other/k", True] == {"allow"}
    assert got["bad.net", "/y", True] == {"block"}                 # its host
    assert got["free.net", "/spam/other/k", True] == {"allow"}     # a host without labels
    assert got["bad.net", "/x/a" + "/s" * 5000, False] == {"block"}


def test_rounds_follow_branches_not_lengths(spark, monkeypatch):
    names = []
    write = urls.written
    monkeypatch.setattr(urls, "written", lambda df, name: names.append(name) or write(df, name))
    shared = ["s"] * 400
    rows = [("h", [*shared, end], 1, 0, 0) for end in ("a", "b")]
    got = urls.grow(spark.createDataFrame(rows, SHAPES)).collect()
    # Without labels the two ends are alike and are merged.
    assert {tuple(r.tree) for r in got} == {(*shared, "*")}
    assert len(names) <= 4


def test_rules_of_equal_length(spark):
    rules = [("allow", "a.b.net/x"), ("block", "b.net/x/y")]
    assert len(rules[0][1]) == len(rules[1][1])
    df = spark.createDataFrame([(1, "http://a.b.net/x/y")], "page_id long, url string")
    for order in (rules, rules[::-1]):
        (row,) = urls.judge(df, order).collect()
        assert (row.rule, row.verdict) == ("a.b.net/x", "allow")
