"""Chunks and model batches of an index run."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions.text import estimate_tokens
from .positions import with_dense_index


def plan_route(n_new: int, threshold: int = fixed.CHUNKED_WRITE_THRESHOLD) -> str:
    """``none``, ``single`` (one plain write) or ``chunked`` (resumable chunks)."""
    if n_new == 0:
        return "none"
    return "single" if n_new < threshold else "chunked"


def route_column(n_new: Column, threshold: int = fixed.CHUNKED_WRITE_THRESHOLD) -> Column:
    """``plan_route`` of a column of counts."""
    return F.when(n_new == 0, "none").when(n_new < threshold, "single").otherwise("chunked")


def chunk_partitions(n_new: int, size: int = fixed.CHUNK_SIZE, most: int = 20_000) -> int:
    """Tasks of a chunked run: one per chunk, up to ``most``."""
    return max(1, min(most, math.ceil(n_new / size)))


def assign_chunks(df: DataFrame, size: int = fixed.CHUNK_SIZE,
                  partitions: int | None = None) -> DataFrame:
    """Number rows by (length, pos) and cut them into chunks of ``size`` rows.

    ``df`` has ``length`` and ``pos``, and should be narrow: texts are joined
    back by key later. Adds ``idx`` and ``chunk_id``.
    """
    order = ["length", "pos"] + ["url"] * ("url" in df.columns)
    numbered = with_dense_index(df, order, "idx", partitions)
    return numbered.withColumn("chunk_id", F.floor(F.col("idx") / size).cast("long"))


def token_estimate(length: int) -> int:
    """``functions.text.estimate_tokens`` of a length, for use inside tasks."""
    return max(1, math.ceil(length / fixed.CHARS_PER_TOKEN))


def greedy_batches(lengths: Sequence[int], max_items: int = fixed.BATCH_MAX_ITEMS,
                   target_tokens: int = fixed.BATCH_TARGET_TOKENS) -> Iterator[tuple[int, int]]:
    """(start, stop) of consecutive batches within both limits; used inside tasks."""
    start = tokens = 0
    for i, length in enumerate(lengths):
        own = token_estimate(length)
        if i > start and (i - start == max_items or tokens + own > target_tokens):
            yield start, i
            start, tokens = i, 0
        tokens += own
    if len(lengths) > start:
        yield start, len(lengths)


def assign_batches(chunked: DataFrame, max_items: int = fixed.BATCH_MAX_ITEMS,
                   target_tokens: int = fixed.BATCH_TARGET_TOKENS) -> DataFrame:
    """Number the model batches of every chunk: chunk_id, idx, tokens, batch_id.

    ``chunked`` has chunk_id, idx and tokens. Inside a chunk, rows are taken by
    ``idx``; a batch closes ahead of the row that would break either limit, and
    a row over the limit is a batch of its own. A chunk has a fixed number of
    rows, so its list is small by construction.
    """
    state = "struct<batch:int,items:int,tokens:bigint,ids:array<int>>"

    def step(acc: Column, row: Column) -> Column:
        fits = (acc["items"] < max_items) & (acc["tokens"] + row["tokens"] <= target_tokens)
        same = fits | (acc["items"] == 0)
        batch = F.when(same, acc["batch"]).otherwise(acc["batch"] + 1)
        return F.struct(
            batch.alias("batch"),
            F.when(same, acc["items"] + 1).otherwise(F.lit(1)).alias("items"),
            F.when(same, acc["tokens"] + row["tokens"]).otherwise(row["tokens"]).alias("tokens"),
            F.array_append(acc["ids"], batch).alias("ids")).cast(state)

    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("items"), F.lit(0).alias("tokens"),
                     F.array().cast("array<int>").alias("ids")).cast(state)
    rows = F.array_sort(F.collect_list(F.struct(
        F.col("idx"), F.col("tokens").cast("long").alias("tokens"))))
    return (
        chunked.groupBy("chunk_id").agg(rows.alias("rows"))
        .withColumn("ids", F.aggregate("rows", start, step, lambda acc: acc["ids"]))
        .select("chunk_id", F.posexplode("rows").alias("_i", "row"), "ids")
        .select("chunk_id", "row.idx", "row.tokens", F.get("ids", F.col("_i")).alias("batch_id"))
    )


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Length and token estimate of a text column."""
    return df.withColumns({"length": F.length(text), "tokens": estimate_tokens(F.col(text))})


def _same_key(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join in which a null key equals a null key."""
    other = right.select(F.col(key).alias("_other"))
    return left.join(other, F.col(key).eqNullSafe(F.col("_other")), how)


def pending(planned: DataFrame, written: DataFrame | None, key: str = "url") -> DataFrame:
    """Planned rows that no finished chunk holds yet, whatever chunk they were in."""
    return planned if written is None else _same_key(planned, written, key, "left_anti")


def matching_keys(written: DataFrame, planned: DataFrame, key: str = "url") -> DataFrame:
    """Finished rows that belong to this plan; leftovers of another run drop out."""
    return _same_key(written, planned, key, "left_semi")
