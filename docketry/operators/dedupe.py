"""Duplicates, membership and unions of keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sizes import BROADCAST_BYTES, measured_bytes


def dedupe_keep_first(df: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Keep the row with the lowest ``order`` per ``key``.

    ``row_number() = 1`` lets Spark keep one row per key and partition before
    the shuffle (``WindowGroupLimit``), so a key with a third of all rows
    sends one row per map task.
    """
    first = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def drop_repeats(df: DataFrame, key: str, order: str = "pos",
                 max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``dedupe_keep_first`` for wide tables that are cheap to read narrowly.

    One pass over (key, order) finds the keys that occur more than once and
    where each first occurs: one row per repeated key, however often it
    repeats. Nothing repeated means ``df`` itself. If those rows are few, they
    are broadcast and filter ``df`` where it is read, so no wide row is sorted
    or shuffled. If they are many, or a first position occurs twice, the
    window does the work.
    """
    firsts = cut_lineage(
        df.groupBy(key, order).agg(F.count(F.lit(1)).alias("_m"))
        .groupBy(key).agg(F.min(F.struct(F.col(order), F.col("_m"))).alias("_first"),
                          F.sum("_m").alias("_n"))
        .filter("_n > 1")
        .select(F.col(key).alias("_key"), F.col(f"_first.{order}").alias("_keep"),
                (F.col("_first._m") > 1).alias("_tied")))
    if firsts.isEmpty():
        return df
    tied = not firsts.filter("_tied").isEmpty()
    if tied or measured_bytes(firsts) > max_bytes:
        return dedupe_keep_first(df, key, order)
    joined = df.join(F.broadcast(firsts), F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.filter(
        F.col("_keep").isNull() | (F.col(order) == F.col("_keep"))).select(*df.columns)


def duplicate_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: total rows, distinct keys (a null key counts as one) and duplicates."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("distinct_keys"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates"),
    )


def membership_set(df: DataFrame, key: str = "url") -> DataFrame:
    """The distinct keys of a store."""
    return df.select(key).distinct()


def union_all(*parts: DataFrame) -> DataFrame:
    """Stack tables by column name; order is carried by ``pos``."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_store(store: DataFrame, *added: DataFrame) -> DataFrame:
    """Existing rows and new ones, one row per url, the lowest position first.

    Only keys are shuffled unless a lot repeats (see ``drop_repeats``). They are
    read in a pass of their own, so vectors still to be encoded are written first.
    """
    return drop_repeats(union_all(store, *added), "url", "pos")
