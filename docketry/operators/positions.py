"""Dense row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_IN_PARTITION = (1 << 33) - 1


def with_dense_index(df: DataFrame, order: list[str], name: str = "idx",
                     partitions: int | None = None) -> DataFrame:
    """Number rows 0..n-1 by ``order``, which has to be unique.

    Rows are range-partitioned and sorted on all of ``order``, so equal leading
    values spread over tasks by the next column. Partition sizes then give each
    partition its offset; only that table of sizes is ordered in one task. The
    sorted rows are checkpointed, because both passes must see the same ranges.
    """
    ranged = (df.repartitionByRange(partitions, *order) if partitions
              else df.repartitionByRange(*order))
    placed = cut_lineage(
        ranged.sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col("_m"), 33)
    sizes = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    # One row per partition of the sort: bounded by the partition count.
    return (
        placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")
        .withColumn(name, F.col("_o") + F.col("_m").bitwiseAND(F.lit(_IN_PARTITION)))
        .drop("_p", "_o", "_m")
    )


def add_position(df: DataFrame, order: list[str]) -> DataFrame:
    """A dense ``pos`` in the given order, e.g. after a filter left gaps."""
    numbered = with_dense_index(df, order, "_dense")
    return numbered.drop("pos").withColumnRenamed("_dense", "pos")
