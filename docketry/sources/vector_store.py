"""The vector store: Parquet segments, and a manifest that says which of them count.

A run adds a segment and never rewrites what is there. A manifest version lists
the segments with their rows, positions, width, key range and a key filter, and
the few urls that more than one row has. A new version appears at once, so a
reader sees the state before or after a change and nothing between. Reading
needs no comparison of keys: what was found when a segment was added is kept.
A folder without a manifest is read as plain Parquet, and its finished segments
(``_SUCCESS``) are taken into the manifest by the first change.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import dedupe_keep_first, drop_repeats
from ..operators.sizes import broadcast_within
from ..session import cut_lineage, delete_folder
from .chunk_store import read_chunks, write_chunks  # noqa: F401  (part of this module's interface)
from .folders import exists, names, read_text, write_new_text

_COLUMNS = ["pos", "url", "embedding"]
# Bits of a key filter for each row, probes for each key, and most bits of a segment's filter.
_FILTER_BITS, _FILTER_PROBES, _FILTER_MOST = 12, 4, 1 << 24
# Filters of segments that one check sends to every task.
_FILTERS_BYTES = 64 << 20


@dataclass
class Segment:
    """A segment as the manifest knows it. ``filtered``: there is a key filter beside it."""
    number: int
    rows: int
    first_pos: int | None = None
    last_pos: int | None = None
    shortest: int | None = None
    longest: int | None = None
    missing: int = 0
    first_key: str | None = None
    last_key: str | None = None
    null_keys: int = 0
    filtered: bool = False

    def may_share_keys(self, other: Segment) -> bool:
        """Whether key ranges overlap, or both have rows without a url."""
        if self.null_keys and other.null_keys:
            return True
        if self.first_key is None or other.first_key is None:
            return False
        return self.first_key <= other.last_key and other.first_key <= self.last_key


@dataclass
class Manifest:
    """One state of a store. ``repeats`` names the table of urls with more than one row."""
    version: int = 0
    segments: list[Segment] = field(default_factory=list)
    repeats: str | None = None
    tied: bool = False

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)


class MergeReport(NamedTuple):
    """What a merge or a compaction did to a store, in rows and segments."""

    total: int
    added: int
    segments: int


def _committed(spark: SparkSession, path: str) -> list[int]:
    return sorted(n for n in _numbers(spark, path) if exists(spark, f"{path}/segment={n}/_SUCCESS"))


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n.split("=")[1]) for n in names(spark, path) if n.startswith("segment=")]


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[1:-5]) for n in names(spark, f"{path}/_manifest")
                  if n.startswith("v") and n.endswith(".json"))


def manifest_of(spark: SparkSession, path: str, version: int | None = None) -> Manifest | None:
    """The newest state of a store, or the given one; None without a manifest."""
    versions = _versions(spark, path)
    if not versions:
        return None
    raw = json.loads(read_text(spark, f"{path}/_manifest/v{version or versions[-1]:012d}.json"))
    return Manifest(raw["version"], [Segment(**s) for s in raw["segments"]], raw["repeats"],
                    raw["tied"])


def _commit(spark: SparkSession, path: str, state: Manifest) -> Manifest:
    """Make ``state`` the next version; fails if somebody else has committed meanwhile."""
    after = replace(state, version=state.version + 1)
    if not write_new_text(spark, f"{path}/_manifest/v{after.version:012d}.json",
                          json.dumps(asdict(after))):
        raise RuntimeError(f"{path} was changed by another run; start again")
    return after


def store_exists(spark: SparkSession, path: str) -> bool:
    state = manifest_of(spark, path)
    return bool(state.segments if state else _committed(spark, path))


def empty_vectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "pos long, url string, embedding array<float>")


def _statistics() -> list[Column]:
    width = F.size("embedding")
    return [
        F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.min(F.when(F.col("embedding").isNotNull(), width)).alias("shortest"),
        F.max(F.when(F.col("embedding").isNotNull(), width)).alias("longest"),
        F.count_if(F.col("embedding").isNull()).alias("missing"),
        F.min("url").alias("first_key"), F.max("url").alias("last_key"),
        F.count_if(F.col("url").isNull()).alias("null_keys")]


def _reject(missing: int, shortest: int | None, longest: int | None) -> None:
    if missing or shortest != longest:
        raise ValueError(f"inconsistent vectors: {missing} missing, "
                         f"lengths from {shortest} to {longest}")


def validate_vectors(vectors: DataFrame) -> DataFrame:
    """Reject a store with null vectors or vectors of unequal length (one narrow pass)."""
    row = vectors.agg(*_statistics()).first()
    _reject(row["missing"], row["shortest"], row["longest"])
    return vectors


def _paths(path: str, segments: list[Segment]) -> list[str]:
    return [f"{path}/segment={s.number}" for s in segments]


def _rows_of(spark: SparkSession, path: str, segments: list[Segment]) -> DataFrame:
    """pos, url, embedding and _segment of the rows as they are stored."""
    rows = spark.read.parquet(*_paths(path, segments))
    number = F.regexp_extract(F.col("_metadata.file_path"), r"segment=(\d+)/[^/]*$", 1).cast("int")
    return rows.select(*_COLUMNS, number.alias("_segment"))


def read_vectors(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Read a store (or a plain Parquet folder), check it, and drop duplicate urls.

    With a manifest this is a scan: widths are known, and urls that more than
    one row has are a table of their own, which filters the scan. Without one,
    duplicates are found by key and position (see ``drop_repeats``).
    ``check=False`` leaves out the check of the vectors, for jobs that need keys only.
    """
    state = manifest_of(spark, path)
    if state is not None and state.segments:
        return _read_state(spark, path, state, check)
    segments = _committed(spark, path)
    paths = [f"{path}/segment={n}" for n in segments] or [path]
    vectors = spark.read.parquet(*paths).select(*_COLUMNS)
    if check:
        validate_vectors(vectors)
    return drop_repeats(vectors, "url", "pos")


def _read_state(spark: SparkSession, path: str, state: Manifest, check: bool = False) -> DataFrame:
    if check:
        full = [s for s in state.segments if s.rows]
        _reject(sum(s.missing for s in full), min((s.shortest or 0 for s in full), default=0),
                max((s.longest or 0 for s in full), default=0))
    if state.repeats is None:
        return spark.read.parquet(*_paths(path, state.segments)).select(*_COLUMNS)
    rows = _rows_of(spark, path, state.segments)
    if state.tied:
        return dedupe_keep_first(rows.select(*_COLUMNS), "url", "pos")
    kept = spark.read.parquet(f"{path}/_manifest/{state.repeats}").select(
        F.col("url").alias("_url"), F.col("pos").alias("_pos"), F.col("segment").alias("_kept"))
    joined = rows.join(broadcast_within(kept), F.col("url").eqNullSafe(F.col("_url")), "left")
    return joined.filter(
        F.col("_kept").isNull() | ((F.col("pos") == F.col("_pos"))
                                   & (F.col("_segment") == F.col("_kept")))).select(*_COLUMNS)


# --- key filters ------------------------------------------------------------------


def _bits_for(rows: int) -> int:
    return 1 << max(10, min(_FILTER_MOST.bit_length() - 1, (_FILTER_BITS * rows).bit_length()))


def _hashes() -> Column:
    """The probes of a url; a url that is null is unlike any text."""
    h = F.xxhash64(F.coalesce("url", F.lit("")), F.col("url").isNull())
    return F.array(h, *[F.xxhash64(h, F.lit(i)) for i in range(1, _FILTER_PROBES)])


def _places(keys: DataFrame, bits: int) -> DataFrame:
    """(word, bit): the places of every url in a filter of so many bits."""
    placed = keys.select(F.explode(_hashes()).alias("h")).select(
        F.pmod("h", F.lit(bits)).alias("place"))
    return placed.select(F.shiftrightunsigned("place", 5).cast("int").alias("word"),
                         F.col("place").bitwiseAND(F.lit(31)).cast("int").alias("bit"))


def _write_filter(spark: SparkSession, path: str, segment: Segment) -> bool:
    """Keep the key filter of a segment: words of 32 bits, at most 2 MB. Spark ORs them."""
    keys = spark.read.parquet(*_paths(path, [segment])).select("url")
    one = F.lit(1).cast("long")
    words = _places(keys, _bits_for(segment.rows)).groupBy("word").agg(
        F.bit_or(F.call_function("shiftleft", one, F.col("bit"))).alias("bits"))
    words.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/keys-{segment.number}")
    return True


def _read_filter(spark: SparkSession, path: str, segment: Segment) -> np.ndarray:
    words = spark.read.parquet(f"{path}/_manifest/keys-{segment.number}").toArrow()
    out = np.zeros(_bits_for(segment.rows) // 32, np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _maybe_known(keys: DataFrame, filters: list[tuple[int, np.ndarray]]) -> DataFrame:
    """The urls that some filter may hold; each is looked up in tasks."""
    spark = keys.sparkSession
    shipped = spark.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, _FILTER_PROBES)
            known = np.zeros(len(values), bool)
            for bits, words in shipped.value:
                place = values % bits
                known |= ((words[place >> 5] >> (place & 31).astype(np.uint32)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(known))],
                                             names=["url"])

    return keys.select("url", _hashes().alias("h")).mapInArrow(run, "url string")


# --- changes ----------------------------------------------------------------------


def _adopted(spark: SparkSession, path: str) -> Manifest:
    """The newest state, or one made of the finished segments of a store without a manifest."""
    state = manifest_of(spark, path)
    if state is not None:
        return state
    state = Manifest()
    for number in _committed(spark, path):
        rows = spark.read.parquet(f"{path}/segment={number}").agg(*_statistics()).first()
        state = _with_segment(spark, path, state, Segment(number, **rows.asDict()), False)
    return state


def _write_segment(vectors: DataFrame, path: str) -> Segment:
    """Write rows as a segment with an unused number; statistics are taken as they pass.

    Numbers of unfinished segments are not used again, so leftovers of a
    failed run cannot mix with this one.
    """
    number = max(_numbers(vectors.sparkSession, path), default=-1) + 1
    seen = Observation()
    vectors.select(*_COLUMNS).observe(seen, *_statistics()).write.mode("error").parquet(
        f"{path}/segment={number}")
    return Segment(number, **seen.get)


def _with_segment(spark: SparkSession, path: str, state: Manifest, segment: Segment,
                  known_new: bool) -> Manifest:
    """The state with one more segment, and the urls that now have several rows.

    ``known_new``: no url of the segment is repeated in it or known to the store,
    so no key is compared. Otherwise keys of the segment meet each other, and
    those that a filter of an earlier segment may hold meet that segment's.
    """
    segment = replace(segment, filtered=_write_filter(spark, path, segment))
    after = Manifest(state.version, [*state.segments, segment], state.repeats, state.tied)
    if known_new or not segment.rows:
        return after
    mine = _rows_of(spark, path, [segment]).select("url", "pos", F.col("_segment").alias("segment"))
    rows = [mine.join(broadcast_within(cut_lineage(mine.groupBy("url").count().filter("count > 1")
                                                   .select(F.col("url").alias("_u")))),
                      F.col("url").eqNullSafe(F.col("_u")), "left_semi")]
    near = [s for s in state.segments if s.rows and s.may_share_keys(segment)]
    if near:
        small = sum(_bits_for(s.rows) // 8 for s in near) <= _FILTERS_BYTES
        maybe = mine.select("url") if not small or not all(s.filtered for s in near) else (
            _maybe_known(mine, [(_bits_for(s.rows), _read_filter(spark, path, s)) for s in near]))
        maybe = cut_lineage(maybe.distinct())
        if not maybe.isEmpty():
            asked = broadcast_within(maybe.select(F.col("url").alias("_u")))
            earlier = _rows_of(spark, path, near).select("url", "pos",
                                                         F.col("_segment").alias("segment"))
            known = cut_lineage(earlier.join(asked, F.col("url").eqNullSafe(F.col("_u")),
                                             "left_semi"))
            if not known.isEmpty():
                again = broadcast_within(known.select(F.col("url").alias("_u")).distinct())
                rows += [known, mine.join(again, F.col("url").eqNullSafe(F.col("_u")), "left_semi")]
    if state.repeats is not None:
        rows.append(spark.read.parquet(f"{path}/_manifest/{state.repeats}").select(
            "url", "pos", "segment"))
    return _with_repeats(spark, path, after, rows)


def _with_repeats(spark: SparkSession, path: str, state: Manifest, rows: list[DataFrame]) -> Manifest:
    """Keep, for every url among ``rows``, the row with the lowest position (then segment)."""
    several = rows[0]
    for more in rows[1:]:
        several = several.unionByName(more)
    place = F.struct("pos", "segment")
    # A row may come in twice, once inside its segment and once among several.
    counted = several.groupBy("url", "pos", "segment").count()
    kept = cut_lineage(counted.groupBy("url").agg(F.min(place).alias("place")).select(
        "url", "place.pos", "place.segment"))
    if kept.isEmpty():
        return replace(state, repeats=None, tied=False)
    # Equal urls at one position of one segment cannot be told apart by a filter.
    stored = _rows_of(spark, path, state.segments).join(
        broadcast_within(kept.select(F.col("url").alias("_u"), F.col("pos").alias("_p"),
                                     F.col("segment").alias("_s"))),
        F.col("url").eqNullSafe(F.col("_u")) & (F.col("pos") == F.col("_p"))
        & (F.col("_segment") == F.col("_s")), "left_semi")
    tied = stored.count() > kept.count()
    name = f"repeats-{state.version + 1:012d}-{state.segments[-1].number}"
    kept.write.mode("overwrite").parquet(f"{path}/_manifest/{name}")
    return replace(state, repeats=name, tied=tied)


def append_vectors(vectors: DataFrame, path: str, known_new: bool = False) -> int:
    """Add rows to the store as a new segment; returns its number.

    ``known_new`` says that the urls are new to the store and not repeated, as a
    delta run knows; then nothing is compared.
    """
    spark = vectors.sparkSession
    state = _adopted(spark, path)
    segment = _write_segment(vectors, path)
    _commit(spark, path, _with_segment(spark, path, state, segment, known_new))
    return segment.number


def write_vectors(vectors: DataFrame, path: str) -> int:
    """Replace the store: write all rows as a new segment, and make it the only one.

    ``vectors`` may be read from ``path`` itself. A reader that has begun goes on
    with the state before; its files go with a later change (see ``vacuum``).
    """
    spark = vectors.sparkSession
    state = _adopted(spark, path)
    segment = _write_segment(vectors, path)
    _commit(spark, path, _with_segment(spark, path, Manifest(state.version), segment, False))
    vacuum(spark, path)
    return segment.number


def merge_vectors(spark: SparkSession, path: str, *added: DataFrame) -> MergeReport:
    """Add what ``added`` has and the store lacks, one row per url, the lowest position first.

    The rows are written once, then compared by key: a url of the store keeps
    its row if that comes first. The report counts rows that a reader sees.
    """
    before = read_vectors(spark, path, check=False).count() if store_exists(spark, path) else 0
    for vectors in added:
        append_vectors(vectors, path)
    state = manifest_of(spark, path)
    total = _read_state(spark, path, state).count()
    return MergeReport(total, total - before, len(state.segments))


def compact(spark: SparkSession, path: str, partitions: int | None = None,
            below: int | None = None) -> MergeReport:
    """Rewrite segments as one in key order, without the rows that readers do not see.

    ``below`` leaves segments of so many rows or more as they are, unless rows
    of theirs are repeated. The new segment takes the place of the old ones in
    one step. Files then hold key ranges of their own, so a search by key reads few.
    """
    state = _adopted(spark, path)
    chosen = [s for s in state.segments if below is None or s.rows < below
              or state.repeats is not None]
    if len(chosen) < 2 and state.repeats is None:
        total = _read_state(spark, path, state).count() if state.segments else 0
        return MergeReport(total, 0, len(state.segments))
    rows = _read_state(spark, path, replace(state, segments=chosen))
    ordered = (rows.repartitionByRange(partitions, "url", "pos") if partitions
               else rows.repartitionByRange("url", "pos")).sortWithinPartitions("url", "pos")
    segment = _write_segment(ordered, path)
    rest = [s for s in state.segments if s not in chosen]
    after = _with_segment(spark, path, Manifest(state.version, rest), segment, True)
    _commit(spark, path, after)
    vacuum(spark, path)
    return MergeReport(sum(s.rows for s in after.segments), 0, len(after.segments))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete what only states before the last ``keep`` ones need; returns the names."""
    versions = _versions(spark, path)
    states = [manifest_of(spark, path, v) for v in versions[-keep:]]
    if not states:
        return []
    used = {s.number for state in states for s in state.segments}
    last = max(used, default=-1)
    needed = ({f"segment={n}" for n in used} | {f"keys-{n}" for n in used}
              | {state.repeats for state in states} | {f"v{s.version:012d}.json" for s in states})
    gone = [n for n in names(spark, path) if n.startswith("segment=") and n not in needed
            and int(n.split("=")[1]) < last and exists(spark, f"{path}/{n}/_SUCCESS")]
    inner = [f"_manifest/{n}" for n in names(spark, f"{path}/_manifest")
             if n.startswith(("v", "keys-", "repeats-")) and n not in needed]
    for name in gone + inner:
        delete_folder(spark, f"{path}/{name}")
    return gone + inner
