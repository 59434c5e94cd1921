"""The delta index job over files as they arrive."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import fixed_values as fixed
from ..operators.models import Encoder
from ..plans.index import delta_index
from ..sources.decisions import ROW_BITS, candidate_projection, drop_blank_text, with_file_position
from ..sources.folders import exists

# Files of a batch by default; their names are on the driver.
FILES_PER_BATCH = 1000
_FOOTERS_AT_ONCE = 8
_FILES = "path string, modificationTime timestamp, length long, content binary"
REJECTED = "batch long, file string, missing array<string>, available array<string>, reason string"


class Layout(NamedTuple):
    """What a file's footer says: its columns, or why it cannot be used."""

    file: str
    schema: T.StructType | None
    missing: list[str]
    reason: str | None


def layout_of(spark: SparkSession, file: str, required: Sequence[str]) -> Layout:
    """Read the footer of a file and hold it against the columns wanted."""
    try:
        schema = spark.read.parquet(file).schema
    except Exception as error:     # whatever keeps a footer from being read is a reason to report
        return Layout(file, None, list(required), f"unreadable: {str(error).splitlines()[0][:200]}")
    missing = [c for c in required if c not in schema.names]
    if missing:
        return Layout(file, schema, missing, "missing columns")
    text = required[-1]
    nested = [c for c in required if isinstance(
        schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if nested or not isinstance(schema[text].dataType, T.StringType):
        return Layout(file, schema, nested or [text], "columns of another type")
    return Layout(file, schema, [], None)


def sort_files(spark: SparkSession, files: Sequence[str],
               required: Sequence[str] = fixed.REQUIRED_COLUMNS) -> tuple[list[Layout], list[Layout]]:
    """(files to read, files set aside), each in the order of their names."""
    with ThreadPoolExecutor(_FOOTERS_AT_ONCE) as pool:
        found = list(pool.map(lambda f: layout_of(spark, f, required), sorted(files)))
    return ([x for x in found if x.reason is None], [x for x in found if x.reason is not None])


def read_files(spark: SparkSession, layouts: Sequence[Layout],
               required: Sequence[str] = fixed.REQUIRED_COLUMNS) -> DataFrame:
    """Decisions of the files, blank texts left out, with a position by file and row.

    Files whose columns have the same types are read together.
    """
    groups: dict[tuple, list[str]] = {}
    for x in layouts:
        kinds = tuple(x.schema[c].dataType.simpleString() for c in required)
        groups.setdefault(kinds, []).append(x.file)
    parts, before = [], 0
    for kinds, files in groups.items():
        schema = ", ".join(f"`{c}` {kind}" for c, kind in zip(required, kinds))
        raw = with_file_position(spark.read.schema(schema).parquet(*files))
        raw = raw.withColumn("pos", F.col("pos") + F.lit(before << ROW_BITS))
        parts.append(drop_blank_text(candidate_projection(raw)))
        before += len(files)
    return reduce(DataFrame.unionByName, parts)


def rejected_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The files that a stream has set aside: batch, file, missing, available, reason."""
    path = f"{checkpoint}/rejected"
    if not exists(spark, path):
        return spark.createDataFrame([], REJECTED)
    return spark.read.schema(REJECTED).parquet(f"{path}/*")


def index_stream(spark: SparkSession, source: str, store_path: str, encoder: Encoder,
                 checkpoint: str, *, files_per_batch: int = FILES_PER_BATCH,
                 available_now: bool = True, **options) -> StreamingQuery:
    """Index new Parquet files below ``source`` into the store, batch by batch.

    The stream is one of file names; a batch reads the files that it names, in as
    many passes as the delta needs, each with the columns it needs. Files have the
    corpus columns, as ``read_decisions`` wants them; this is seen from their
    footers before a row is read. A file that lacks a column, has another type for it
    or cannot be read is set aside and reported (``rejected_files``), and the
    others go on. Rows without a text are dropped. A document is known by its url.
    A batch that is run again after a failure adds nothing twice: urls already
    in the store are left out, and chunks of another encoder are not taken up. The
    stream checkpoint remembers finished files. ``options`` go to ``delta_index``.
    """
    arriving = (
        spark.readStream.format("binaryFile").schema(_FILES)
        .option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch)
        .load(source).select("path"))

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # As many names as a batch has files.
        good, bad = sort_files(session, [r["path"] for r in batch.collect()])
        if bad:
            session.createDataFrame(
                [(batch_id, x.file, x.missing, x.schema.names if x.schema else [], x.reason)
                 for x in bad], REJECTED).coalesce(1).write.mode("overwrite").parquet(
                f"{checkpoint}/rejected/batch-{batch_id}")
        if good:
            delta_index(read_files(session, good), store_path, encoder,
                        work_path=f"{checkpoint}/chunks-{batch_id}", **options)

    writer = arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
