"""Index jobs: build an aligned index, and add only what is new to a store."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..operators.batching import (assign_chunks, chunk_partitions, matching_keys, pending,
                                  plan_route)
from ..operators.dedupe import dedupe_keep_first, drop_repeats
from ..operators.joins import align, new_decisions
from ..operators.models import Encoder, TokenCounter, encode, encoder_fingerprint
from ..operators.sizes import BROADCAST_BYTES, broadcast_within, measured_bytes
from ..session import cut_lineage, delete_folder
from ..sources.chunk_store import read_chunks, run_folder, write_chunks
from ..sources.vector_store import (append_vectors, empty_vectors, read_vectors, store_exists,
                                    write_vectors)


# Tasks of a run for each core, and characters of a task beyond them: what is lost if it breaks off.
RUN_TASKS_PER_CORE, TASK_CHARS = 8, 16 << 20


class DeltaReport(NamedTuple):
    """What a delta run did; ``cut`` counts the texts that ``max_chars`` or tokens shortened."""

    route: str
    before: int
    added: int
    total: int
    cut: int = 0


def build_index(decisions: DataFrame, vectors: DataFrame, path: str) -> DataFrame:
    """Align a store to a corpus, normalise, and keep the result for searching."""
    write_vectors(align(decisions, vectors), path)
    return read_vectors(decisions.sparkSession, path)


def new_keys(decisions: DataFrame, store: DataFrame) -> DataFrame:
    """pos and url of the decisions the store lacks, materialised; reads no text.

    Duplicate urls in the corpus are dropped here, ahead of any encoding.
    """
    keys = dedupe_keep_first(decisions.select("pos", "url"), "url", "pos")
    if not store.filter("url is null").isEmpty():
        keys = keys.filter("url is not null")     # the store keeps one row without a url
    return cut_lineage(new_decisions(keys, store))


def new_documents(decisions: DataFrame, keys: DataFrame) -> DataFrame:
    """pos, url, text and length of the new decisions.

    A small delta is picked where texts are read and kept, so the corpus is
    passed once. A delta too large for that is most of the corpus; it is read
    again when needed, not written a second time. A document is known by url and
    position together: files may each count from 0.
    """
    size = measured_bytes(keys)
    wanted = broadcast_within(keys.select(F.col("pos").alias("_pos"), F.col("url").alias("_url")),
                              at_most=size)
    # Lengths are taken in the scan, so that planning a large delta moves no text.
    picked = decisions.select("pos", "url", "text", F.length("text").alias("length")).join(
        wanted, F.col("pos").eqNullSafe(F.col("_pos")) & F.col("url").eqNullSafe(F.col("_url")),
        "left_semi")
    return cut_lineage(picked) if size <= BROADCAST_BYTES else picked


def plan_delta(documents: DataFrame, chunk_size: int = fixed.CHUNK_SIZE) -> DataFrame:
    """Number new documents by (length, pos, url): source_pos, url, length, idx, chunk_id."""
    length = F.col("length") if "length" in documents.columns else F.length("text")
    lengths = cut_lineage(documents.select("pos", "url", length.alias("length")))
    return assign_chunks(lengths, chunk_size).withColumnRenamed("pos", "source_pos")


def encode_planned(documents: DataFrame, planned: DataFrame, encoder: Encoder, first_pos: int,
                   partitions: int, max_chars: int | None = None, **limits) -> DataFrame:
    """Vectors of the planned documents, similar lengths side by side; model calls keep to a chunk.

    Texts cross one shuffle. Chunks are dealt out to tasks by number, which
    needs no sampling pass over the texts and spreads long ones.
    """
    wanted = planned.select(F.col("source_pos").alias("_pos"), F.col("url").alias("_url"), "idx",
                            "chunk_id")
    texts = documents.join(
        broadcast_within(wanted),
        F.col("pos").eqNullSafe(F.col("_pos")) & F.col("url").eqNullSafe(F.col("_url")))
    task = F.pmod("chunk_id", F.lit(partitions)).cast("int")
    ordered = texts.repartitionById(partitions, task).sortWithinPartitions("idx")
    vectors = encode(ordered, encoder, max_chars=max_chars, keep=["url", "idx", "chunk_id"],
                     group="chunk_id", **limits)
    return vectors.select(
        (F.lit(first_pos) + F.col("idx")).alias("pos"), "url", "embedding", "chunk_id",
        *[c for c in vectors.columns if c == limits.get("cut")])


def delta_index(decisions: DataFrame, store_path: str, encoder: Encoder, *,
                encoder_name: str | None = None, work_path: str | None = None,
                chunk_size: int = fixed.CHUNK_SIZE,
                threshold: int = fixed.CHUNKED_WRITE_THRESHOLD,
                max_chars: int | None = None, max_tokens: int | None = None,
                counter: TokenCounter | None = None) -> DeltaReport:
    """Encode the decisions the store lacks and add them as a new segment.

    Nothing new means no text read and nothing written. A run of fewer than
    ``threshold`` texts is one write, which starts anew if it breaks off. A larger run
    writes chunks below ``work_path`` first; when it is started again it skips
    every url a finished chunk holds. Its folder is named after the encoder, the limits
    and the state of the store, so chunks of another run are not taken up; the
    encoder is known by ``encoder_name`` or by its vectors of fixed texts (see
    ``encoder_fingerprint``). The folder is deleted once the segment is there. Existing
    rows are never rewritten. A run that would lose or repeat a document fails.
    Whole texts are encoded unless ``max_chars``, or ``max_tokens`` with a
    ``counter``, cuts them; the report says how many.
    """
    spark = decisions.sparkSession
    known = store_exists(spark, store_path)
    store = read_vectors(spark, store_path, check=False) if known else empty_vectors(spark)
    size = store.agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last")).first()
    first_pos = 0 if size["last"] is None else size["last"] + 1
    keys = new_keys(decisions, store)
    n_new = keys.count()
    route = plan_route(n_new, threshold)
    if route == "none":
        return DeltaReport(route, size["n"], 0, size["n"])
    documents = new_documents(decisions, keys)
    planned = plan_delta(documents, chunk_size)
    found, chars = _planned_size(planned)
    if found > n_new:      # equal url and position in several files: one of them stays
        documents = cut_lineage(documents.dropDuplicates(["pos", "url"]))
        planned = plan_delta(documents, chunk_size)
        found, chars = _planned_size(planned)
    if found != n_new:
        raise ValueError(f"{n_new} new urls, but texts for {found}")
    by_tokens = max_tokens is not None and counter is not None
    cut = 0 if max_chars is None else planned.filter(F.col("length") > max_chars).count()
    tasks = chunk_partitions(n_new, chunk_size, most=run_tasks(spark, chars))
    limits = {"max_chars": max_chars, "max_tokens": max_tokens, "counter": counter}
    work = None
    if route == "single":
        marks = {"cut": "_cut"} if by_tokens else {}
        rows = encode_planned(documents, planned, encoder, first_pos, tasks, **limits, **marks)
        if by_tokens:
            rows = cut_lineage(rows)
            cut = rows.filter("_cut").count()
    else:
        root = work_path or f"{store_path}/_chunks"
        work = run_folder(spark, root, {
            "encoder": encoder_fingerprint(spark, encoder, encoder_name, **limits),
            "max_chars": max_chars, "max_tokens": max_tokens, "rows": size["n"],
            "first_pos": first_pos})
        _write_pending(spark, documents, planned, encoder, first_pos, tasks, limits, work)
        if by_tokens:
            cut = _count_cut(documents, limits)
        rows = drop_repeats(matching_keys(read_chunks(spark, work), planned), "url", "pos")
    gathered = rows.select("pos", "url", "embedding")
    append_vectors(gathered, store_path, known_new=True)
    if work is not None:
        # Runs that began at an earlier state of the store cannot go on either.
        delete_folder(spark, root)
    total = read_vectors(spark, store_path, check=False).count()
    if total - size["n"] != n_new:
        raise ValueError(f"{n_new} new documents, but {total - size['n']} rows were added")
    return DeltaReport(route, size["n"], n_new, total, cut)


def _planned_size(planned: DataFrame) -> tuple[int, int]:
    """Rows of a plan and the characters of their texts."""
    row = planned.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("chars")).first()
    return row["n"], row["chars"] or 0


def run_tasks(spark: SparkSession, chars: int) -> int:
    """Most tasks of a run: they follow the text, not the number of chunks dealt to them."""
    return max(RUN_TASKS_PER_CORE * spark.sparkContext.defaultParallelism, chars // TASK_CHARS + 1)


def _no_vectors(texts: list[str]) -> list[list[float]]:
    return [[0.0]] * len(texts)


def _count_cut(documents: DataFrame, limits: dict) -> int:
    """Texts that the token limit shortens; a pass of its own, as a resumed run reads only some."""
    counted = encode(documents, _no_vectors, keep=["url"], cut="_cut", **limits)
    return counted.filter("_cut").count()


def _write_pending(spark: SparkSession, documents: DataFrame, planned: DataFrame,
                   encoder: Encoder, first_pos: int, tasks: int, limits: dict,
                   work: str) -> None:
    written = read_chunks(spark, work)
    todo = pending(planned, written)
    if written is not None:
        # New chunk numbers, so that finished chunks are not replaced.
        last = written.agg(F.max("chunk_id")).first()[0]
        todo = todo.withColumn("chunk_id", F.col("chunk_id") + F.lit(int(last or 0) + 1))
    write_chunks(encode_planned(documents, todo, encoder, first_pos, tasks, **limits), work)
