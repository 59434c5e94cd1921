"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_files, join_spread, passing, written


def _with_least(links: DataFrame) -> DataFrame:
    """Rows (u, v, m) with m the least of u and its neighbours; ``links`` is a written table.

    Partial minima combine first, and the hub of a star is joined apart.
    """
    least = written(few_files(links.groupBy("u").agg(
        F.min("v").alias("_v"), F.count(F.lit(1)).alias("_n"))), "least")
    return join_spread(links, least.select("u", F.least("u", "_v").alias("m"), "_n"), "u", "_n")


def connected(links: DataFrame) -> DataFrame | None:
    """(node, root) for every node of (a, b) links, root the least node; None without links.

    Each round links the larger neighbours of every node to the least one, then
    the smaller ones, until every node hangs on its root. Rounds grow with the
    logarithm of the longest chain; a stage is written to the shared folder, and what only
    a round needs is deleted after it. A link with a null end is none; repeated ones count once.
    """
    edges = written(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        # The number of links and a sum over them tell whether a round changed anything.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0:
            return None
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        with passing(edges.sparkSession):
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = written(few_files(_with_least(both).filter("v > u").select(
                F.col("v").alias("u"), F.col("m").alias("v")).distinct()), "large")
            small = _with_least(large)
            small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                small.select("u", F.col("m").alias("v")))
            edges = written(few_files(small.filter("u <> v").distinct()), "edges", kept=True)
