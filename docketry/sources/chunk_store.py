"""Chunks of vectors that an index run finishes one by one, so that it can be resumed.

A run has a folder named after what decides its vectors (``run_folder``), with
that identity in clear beside the chunks. A task writes the chunks dealt to it
as one file, and the file is there as soon as the task has ended, whole, also if
the job breaks off later. Nothing is listed by chunk.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_within
from ..session import cut_lineage
from .folders import exists, names, read_text, write_new_text

_IDENTITY = "_run.json"
_SCHEMA = "pos long, url string, embedding array<float>, chunk_id long, try int"


def run_folder(spark: SparkSession, root: str, identity: dict) -> str:
    """The folder of the run with this identity below ``root``; another identity, another folder."""
    text = json.dumps(identity, sort_keys=True)
    path = f"{root}/run-{hashlib.md5(text.encode()).hexdigest()}"
    if not exists(spark, f"{path}/{_IDENTITY}"):
        write_new_text(spark, f"{path}/{_IDENTITY}", text)
    return path


def run_identity(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, f"{path}/{_IDENTITY}"))


def _tries(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in names(spark, path) if n.startswith("try="))


def write_chunks(vectors: DataFrame, path: str) -> int:
    """Write rows with a ``chunk_id``, one file a task; returns the number of this try.

    Rows of a chunk have to be in one task, as ``encode_planned`` deals them. Version 2
    of the file committer moves a task's file to its place when the task ends, so
    what a broken-off run has finished stays. On a store without renames a
    file appears when its upload ends, which is as good.
    """
    number = max(_tries(vectors.sparkSession, path), default=-1) + 1
    vectors.select("pos", "url", "embedding", "chunk_id").write.mode("append").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{path}/try={number}")
    return number


def _all_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    tries = _tries(spark, path)
    if not tries:
        return None
    return spark.read.schema(_SCHEMA).option("basePath", path).parquet(
        *[f"{path}/try={n}" for n in tries])


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the chunks finished so far, or None without any.

    A chunk that was written in several tries counts as the last one wrote it.
    """
    found = _all_chunks(spark, path)
    if found is None or len(_tries(spark, path)) == 1:
        return found if found is None else found.drop("try")
    last = cut_lineage(found.groupBy("chunk_id").agg(
        F.max("try").alias("_last"), F.min("try").alias("_first")).filter("_first < _last")
        .select(F.col("chunk_id").alias("_chunk"), "_last"))
    if last.isEmpty():
        return found.drop("try")
    kept = found.join(broadcast_within(last), F.col("chunk_id") == F.col("_chunk"), "left")
    return kept.filter(F.col("_last").isNull() | (F.col("try") == F.col("_last"))).select(
        "pos", "url", "embedding", "chunk_id")


def finished_ranges(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: try, file, first_chunk, last_chunk, chunks, rows; reads chunk numbers only."""
    found = _all_chunks(spark, path)
    if found is None:
        return spark.createDataFrame([], "try int, file string, first_chunk long,"
                                     " last_chunk long, chunks long, rows long")
    return found.select("try", F.col("_metadata.file_name").alias("file"), "chunk_id").groupBy(
        "try", "file").agg(
        F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"),
        F.count_distinct("chunk_id").alias("chunks"), F.count(F.lit(1)).alias("rows"))
