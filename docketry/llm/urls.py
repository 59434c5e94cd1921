"""URL filter: rules first, then a path-template tree per host.

The rules are a short list; of those that fit, the longest decides (of equals
that with the longer host). Urls with a rule are the labelled examples. For the
others every host has a tree of path segments. Segments of digits, or with digits
in them, are wildcards from the start. From the root down, a node with many children
of few urls each has them generalised into ``*``, and children whose share of
blocked labels is not significantly unlike that of their siblings are merged into
``*`` as well. A node's purity is its share of blocked labels, smoothed towards that
of its parent; the host's is smoothed towards the share of all labels. A template that
ends where others go on is a child of its node, and an only child is one with its parent.
A template is rejected if its purity reaches ``purity``: one without labels is
judged as its branch is, one of a host without labels is allowed.

Work is on counts of (host, template), which combine before the shuffle, so a
host with a third of all rows is one row per template. Null urls and urls without
``://`` have an empty host and path and share one template. Rows with equal or
null ids each give their own row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_within
from .common import written

MANY, FEW_URLS = 20, 4
STRENGTH, PURITY, Z = 4.0, 0.7, 1.96

Rule = tuple[str, str]   # ("allow" or "block", "host/path")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), "^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return (F.coalesce(F.translate(host, upper, lower), F.lit("")),
            F.coalesce(path, F.lit("")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, null without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    # Shortest first, so that later, longer ones go on top.
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"))):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(
            slash + rule_path)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
                       ).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """Path segments, the variable ones generalised by their looks."""
    parts = F.transform(F.split(path, "/"), lambda s: F.when(s.rlike("^[0-9]+$"), "{n}")
                        .when(s.rlike("[0-9]"), "{x}").otherwise(s))
    return F.slice(parts, 2, F.lit(1 << 30))


def common_start(lo: Column, hi: Column) -> Column:
    """How many leading elements two arrays share; those of all arrays between them, too."""
    alike = F.zip_with(lo, hi, lambda a, b: F.coalesce(a == b, F.lit(False)))
    apart = F.array_position(alike, False)
    return F.when(apart == 0, F.size(alike)).otherwise(apart - 1).cast("int")


def smoothed(bad: Column, labels: Column, towards: Column) -> Column:
    return (bad + F.lit(STRENGTH) * towards) / (labels + F.lit(STRENGTH))


def grow(shapes: DataFrame) -> DataFrame:
    """Every (host, template) row with its generalised template ``tree``, and of that node
    ``purity`` (null for a host without labels) and ``node_rows``, the rows in it and below it.

    A round takes the next segment and all that follow it in every template of the
    child. A row that is alone in its node takes the rest of its segments. So rounds follow
    the number of branches on a path, not its length.
    """
    hosts = shapes.groupBy("host").agg(
        F.count(F.lit(1)).alias("node_rows"), F.sum("bad").alias("b"),
        F.sum(F.col("good") + F.col("bad")).alias("l"))
    share = F.lit(_share_of_all(shapes))
    current = shapes.join(hosts.select("host", "node_rows", F.when(
        F.col("l") > 0, smoothed(F.col("b"), F.col("l"), share)).alias("purity")), "host").select(
        "host", "template", "n", "good", "bad", "node_rows", "purity", F.lit(0).alias("at"),
        F.array().cast("array<string>").alias("tree"))
    ended = []
    while True:
        ended.append(current.filter(F.size("template") <= F.col("at")))
        here = current.filter(F.size("template") > F.col("at")).withColumn(
            "seg", F.get("template", F.col("at")))
        if here.isEmpty():
            return written(reduce(DataFrame.unionByName, ended).drop("at"), "tree")
        to = F.when(F.col("node_rows") == 1, F.size("template")).otherwise(
            F.col("at") + 1 + F.col("shared"))
        grown = here.drop("node_rows", "purity").join(_children(here), ["host", "tree", "seg"])
        grown = written(grown.select(
            "host", "template", "n", "good", "bad", "node_rows", "purity", to.alias("at"),
            F.concat("tree", F.array("name"), F.slice(
                "template", F.col("at") + 2, to - F.col("at") - 1)).alias("tree")), "tree")
        ended.append(grown.filter("node_rows = 1"))
        current = grown.filter("node_rows > 1")


def _children(here: DataFrame) -> DataFrame:
    """(host, tree, seg) of a round's rows with the child's ``name``, its rows and purity, and
    how many segments all its templates ``shared`` after this one."""
    rest = F.slice("template", F.col("at") + 2, F.size("template"))
    children = here.groupBy("host", "tree", "seg").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.sum("good").alias("good"),
        F.sum("bad").alias("bad"), F.first("purity").alias("above"),
        F.first("node_rows").alias("above_rows"), F.min(rest).alias("lo"), F.max(rest).alias("hi"))
    nodes = children.groupBy("host", "tree").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all_n"),
        F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    labels, others = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad")
    rest_labels = others - labels
    pooled = F.try_divide("all_bad", others)
    unlike = F.abs(F.try_divide("bad", labels) - F.try_divide(
        F.col("all_bad") - F.col("bad"), rest_labels))
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), labels)
                                             + F.try_divide(F.lit(1), rest_labels)))
    # Null where a side has no labels, and without a spread.
    distinct = F.try_divide(unlike, spread) >= Z
    variable = (F.col("kinds") > MANY) & (F.col("kinds") * FEW_URLS > F.col("all_n"))
    # An only child has nothing to be merged with.
    single = F.col("kinds") == 1
    plain = F.coalesce((distinct | single) & ~variable, F.lit(False))
    named = children.join(nodes, ["host", "tree"]).withColumn(
        "name", F.when(plain, F.col("seg")).otherwise("*"))
    sums = named.groupBy("host", "tree", "name").agg(
        F.sum("rows").alias("node_rows"), F.sum("bad").alias("b"),
        F.sum(F.col("good") + F.col("bad")).alias("l"), F.first("above").alias("above"),
        F.first("above_rows").alias("above_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sums = sums.select(
        "host", "tree", "name", "node_rows", common_start(F.col("lo"), F.col("hi")).alias("shared"),
        F.when(F.col("node_rows") == F.col("above_rows"), F.col("above")).otherwise(
            smoothed(F.col("b"), F.col("l"), F.col("above"))).alias("purity"))
    return named.select("host", "tree", "seg", "name").join(sums, ["host", "tree", "name"])


def _share_of_all(shapes: DataFrame) -> float:
    """The share of blocked labels among all."""
    b, l = shapes.agg(F.sum("bad"), F.sum(F.col("good") + F.col("bad"))).first()
    return b / l if l else 0.0


def template_purity(shapes: DataFrame) -> DataFrame:
    """(host, template, tree, purity) of every row; null purity for hosts without labels."""
    tree = grow(shapes)
    ends = tree.groupBy("host", "tree").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("bad").alias("b"),
        F.sum(F.col("good") + F.col("bad")).alias("l"), F.first("purity").alias("node"),
        F.first("node_rows").alias("node_rows"))
    ends = ends.select("host", "tree", F.when(
        F.col("rows") == F.col("node_rows"), F.col("node")).otherwise(
        smoothed(F.col("b"), F.col("l"), F.col("node"))).alias("purity"))
    return tree.select("host", "template", "tree").join(ends, ["host", "tree"])


def rejected_templates(shapes: DataFrame, purity: float = PURITY) -> DataFrame:
    """(host, template) rows whose generalised template is bad by its smoothed purity."""
    return template_purity(shapes).filter(F.col("purity") >= purity).select("host", "template")


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id",
          url_col: str = "url", purity: float = PURITY) -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    host, path = host_and_path(F.col(url_col))
    parsed = (pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
              .withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
              .withColumn("template", segments(F.col("path"))))
    verdict = F.col("_r.verdict")
    shapes = written(parsed.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(verdict == "allow").alias("good"),
        F.count_if(verdict == "block").alias("bad")), "shapes")
    bad = written(rejected_templates(shapes, purity).select(
        F.col("host").alias("_h"), F.col("template").alias("_t"), F.lit(True).alias("_bad")), "bad")
    joined = parsed.join(broadcast_within(bad), (F.col("host") == F.col("_h"))
                         & (F.col("template") == F.col("_t")), "left")
    return joined.select(
        id_col, "host", "path", F.col("_r.rule").alias("rule"),
        F.coalesce(verdict, F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"))
