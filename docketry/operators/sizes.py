"""Measured sizes, and broadcasts that depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

# Largest table, in bytes of its values, that is sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024


def _flat(fields, prefix: str = ""):
    """Fields, those of structs in their stead, under names that reach them."""
    for field in fields:
        name = f"{prefix}`{field.name}`"
        if isinstance(field.dataType, StructType):
            yield from _flat(field.dataType.fields, f"{name}.")
        else:
            yield StructField(name, field.dataType)


def measured_bytes(df: DataFrame) -> int:
    """Size of the values of a table: text and binary bytes, and 16 for any other value or element."""
    width = F.lit(16 * len(df.columns)).cast("long")
    for field in _flat(df.schema.fields):
        if isinstance(field.dataType, ArrayType):
            width = width + 16 * F.greatest(F.size(field.name), F.lit(0))
            if isinstance(field.dataType.elementType, StringType):
                text = F.array_join(field.name, "")
                width = width + F.coalesce(F.octet_length(text), F.lit(0))
        elif isinstance(field.dataType, (StringType, BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def broadcast_within(df: DataFrame, max_bytes: int = BROADCAST_BYTES,
                     at_most: int | None = None) -> DataFrame:
    """Ask for a broadcast only if ``df`` is small enough.

    It is measured, unless ``at_most`` already bounds its bytes. Beyond the
    limit the join is left to Spark, which shuffles both sides and splits
    skewed keys. Meant for tables that are materialised or cheap to read.
    """
    size = measured_bytes(df) if at_most is None else at_most
    return F.broadcast(df) if size <= max_bytes else df
