"""What the operators of this subpackage share: tables, written stages, Arrow maps."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import checkpoint_dir, delete_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# A writer holds a row group of each open file in memory.
ROW_GROUP_BYTES = 16 << 20
# Tasks for each core that still keep all cores busy to the end, and bytes of input of a task.
TASKS_PER_CORE, TASK_BYTES = 4, 64 << 20


# The folders that each open ``passing`` block has to delete, innermost last.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what ``written`` wrote inside, but for tables that are ``kept``.

    For blocks whose result is written, and kept, before they end.
    """
    mine: list[str] = []
    token = _passing.set((*_passing.get(), mine))
    try:
        yield
    finally:
        _passing.reset(token)
        for path in mine:
            delete_folder(spark, path)


def written(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors cost no rework.

    A ``kept`` table outlives the innermost ``passing`` block, but not the one around that.
    """
    path = scratch(df.sparkSession, name)
    blocks = _passing.get()
    if len(blocks) > kept:
        blocks[-1 - kept].append(path)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``df`` in at most ``TASKS_PER_CORE`` tasks a core, without a shuffle.

    For tables that arrive in many small pieces. A task works through its pieces one by one, so
    its memory stays. Work over whole texts names its ``source``: for more than ``TASK_BYTES``
    of input a task the number grows with the input, so that no task gets longer.
    """
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    if source is not None:
        size = source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        tasks = max(tasks, min(int(str(size)) // TASK_BYTES + 1, (1 << 31) - 1))
    return df.coalesce(tasks)


# A key with more than one in this many rows is joined apart.
HOT_SHARE = 1024


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, count: str,
                how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``keyed``, one row per ``key`` and the ``count`` of ``rows`` with it.

    Keys with more than one in ``HOT_SHARE`` of these rows, at most that many, are sent to the
    tasks that read their rows; only the others are shuffled. Both tables are read twice, so
    they have to be written ones. ``how`` is inner or left.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) > total // HOT_SHARE
    hot, rare = keyed.filter(is_hot).drop(count), keyed.filter(~is_hot).drop(count)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(others.join(rare, key, how))


def own_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that is no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    found, n = name, 0
    while found.lower() in taken:
        n += 1
        found = f"{name}_{n}"
    return found


def digest_of(text: str) -> Column:
    """MD5 of a text column; what tells rows of one id apart. Null is like the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def remainder_of_id(id_column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; what splits training from held-out rows."""
    return F.crc32(id_column.cast("string").cast("binary")) % F.lit(divisor)


# Rows and bytes that a Python worker gets at once; texts may be long.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small in this session; results do not depend on it."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, str(most)).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_kept: dict[str, dict] = {}


def give_back() -> None:
    """Return memory that this worker no longer uses, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_table(owner: str | None) -> dict:
    """A table that a Python worker keeps between tasks of one operator.

    Tables of other operators and unused memory are let go.
    """
    give_back()
    if owner not in _kept:
        _kept.clear()
    return _kept.setdefault(owner, {}) if owner else {}


def map_texts(df: DataFrame, columns: list[Column], schema: str,
              make: Callable[[], Callable[[list, list], list[list]]],
              bytes_at_once: int = 4 << 20, owner: str | None = None) -> DataFrame:
    """Run a function over (keys..., text) rows in pieces of bounded size.

    ``columns`` end with the text column. ``make`` is called once per task and
    returns a function of (list of key tuples, list of texts or None) that
    gives one list per output column. A piece closes at ``bytes_at_once``, so
    memory follows that size and the longest text, not the Arrow batch. ``owner``
    names the operator whose worker table lives on.
    """
    bounded_batches(df.sparkSession)
    narrow = df.select(*[c.alias(f"_c{i}") for i, c in enumerate(columns)])
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_table(owner)
        step = make()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            lengths = texts.nbytes
            rows = max(1, min(batch.num_rows, bytes_at_once * batch.num_rows // max(1, lengths)))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                keys = list(zip(*[part.column(i).to_pylist()
                                  for i in range(part.num_columns - 1)]))
                made = step(keys, part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, type=field.type)
                     for values, field in zip(made, out)], schema=out)
            del batch, texts
            pa.default_memory_pool().release_unused()
        give_back()

    return narrow.mapInArrow(run, schema)

