"""Substring deduplication with content-defined chunks.

A gear hash rolls over the bytes of a text: h = (h << 1) + GEAR[byte] in 32 bits,
so it depends on the last 32 bytes only. A chunk starts where the hash is least
within some window of ``window`` bytes: every window has a cut, and an insertion
moves cuts near it only. A chunk's digest (XXH64) covers the chunk and the 32
bytes before it, on which its cut depends.

Of the occurrences of a digest the one with the smallest (id, offset) stays.
Neighbouring chunks that all occur earlier form a run. A run is cut from the
text if it has at least ``min_bytes`` and half of that lines up with one earlier
place, so chance repeats of single chunks do no harm. A passage of
``min_bytes + 32 + 2 * window`` bytes that occurs earlier always holds such a
run (256 bytes by default, about 40 words), wherever it sits.

Null and empty texts have no chunks. Rows with a null id cannot be named: they
are neither cut nor a source. Rows that share an id are one document and are not
deduplicated against each other. Texts without cuts (one repeated byte) are cut
every 4 kB. Other columns are ignored by ``repeated_spans`` and kept by ``cut``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_within
from .common import bounded_batches, few_files, map_texts, own_name, worker_table, written

REACH = 32               # bytes that a 32-bit gear hash depends on
WINDOW, MIN_BYTES = 64, 96
LEAST_GAP, MOST_GAP = 8, 4096
SEGMENT = 1 << 20


def gear_table() -> np.ndarray:
    """256 random words from a fixed rule (splitmix64), byte 0 at zero for the padding."""
    state = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    table = ((state ^ (state >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)
    table[0] = 0
    return table


_GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte, all at once: windows double five times."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over [i, i + width) for every i that has a whole window."""
    done, out = 1, values
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[:len(out) - rest], out[rest:]) if rest else out


def least_in_window(h: np.ndarray, window: int) -> np.ndarray:
    """Whether each value is least in some window that holds it."""
    most = np.uint32(0xFFFFFFFF)
    edge = np.full(window - 1, most, np.uint32)
    least = _sliding(np.concatenate((edge, h, edge)), window, np.minimum)
    return (_sliding(least, window, np.maximum) == h) & (h != most)


def cuts_of_many(texts: list[bytes], window: int = WINDOW) -> list[list[int]]:
    """Chunk starts of every text, 0 first. Texts are hashed together, kept apart by padding."""
    out: list[list[int]] = []
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at]) <= SEGMENT):
            group.append(texts[at])
            size += len(texts[at]) + REACH
            at += 1
        out += ([_long_cuts(group[0], window)] if size > 2 * SEGMENT
                else _group_cuts(group, window))
    return out


def _group_cuts(group: list[bytes], window: int) -> list[list[int]]:
    pad = bytes(max(REACH, window))
    data = np.frombuffer(pad.join(group), np.uint8)
    h = gear_hashes(data)
    lengths = np.array([len(g) for g in group])
    starts = np.cumsum(lengths + len(pad)) - lengths - len(pad)
    for a in starts[1:]:
        h[a - len(pad):a] = 0xFFFFFFFF
    at = np.flatnonzero(least_in_window(h, window))
    edges = np.searchsorted(at, np.stack([starts, starts + lengths]))
    return [_spaced(at[a:b] - s, n) for a, b, s, n in
            zip(edges[0], edges[1], starts.tolist(), lengths.tolist())]


def _long_cuts(text: bytes, window: int) -> list[int]:
    """The same cuts for a long text, in segments with enough context on both sides."""
    found = []
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), SEGMENT):
        lo, hi = max(0, at - REACH - window), min(len(data), at + SEGMENT + window)
        h = gear_hashes(data[lo:hi])
        warm = min(REACH, lo)  # these hashes lack their first bytes; no window in use holds them
        cuts = np.flatnonzero(least_in_window(h[warm:], window)) + lo + warm
        found.append(cuts[(cuts >= at) & (cuts < at + SEGMENT)])
    return _spaced(np.concatenate(found), len(data))


def _spaced(cuts: np.ndarray, length: int) -> list[int]:
    """Cuts at least ``LEAST_GAP`` and at most ``MOST_GAP`` apart, from 0."""
    if length == 0:
        return []
    gaps = np.diff(cuts, prepend=0, append=length)
    if len(cuts) and gaps[:-1].min() >= LEAST_GAP and gaps.max() <= MOST_GAP:
        return [0, *cuts.tolist()]
    out = [0]
    for cut in [*cuts.tolist(), length]:
        while cut - out[-1] > MOST_GAP:
            out.append(out[-1] + MOST_GAP)
        if cut - out[-1] >= LEAST_GAP and cut < length:
            out.append(cut)
    return out


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                window: int = WINDOW) -> DataFrame:
    """(digest, id, begin, end, seen): chunks; ``seen`` is an earlier offset in the same text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        import xxhash

        digest = xxhash.xxh64_intdigest

        def run(keys, texts):
            data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            digests: list[np.ndarray] = []
            ids, begins, ends, seen = [], [], [], []
            for key, text, cuts in zip(keys, data, cuts_of_many(data, window)):
                if not cuts:
                    continue
                stops = cuts[1:] + [len(text)]
                values = [digest(text[max(0, a - REACH):b]) for a, b in zip(cuts, stops)]
                digests.append(np.array(values, np.uint64))
                ids += [key[0]] * len(cuts)
                begins += cuts
                ends += stops
                if len(set(values)) == len(values):
                    seen += [None] * len(values)
                else:
                    first: dict[int, int] = {}
                    for value, a in zip(values, cuts):
                        before = first.setdefault(value, a)
                        seen.append(None if before == a else before)
            flat = np.concatenate(digests).view(np.int64) if digests else np.zeros(0, np.int64)
            return [flat, ids, begins, ends, seen]

        return run

    return map_texts(docs.filter(F.col(id_col).isNotNull()), [F.col(id_col), F.col(text_col)],
                     f"digest long, id {id_type}, begin int, end int, seen int", make, 2 << 20)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, begin, end, source): byte spans to cut, and the id that keeps most of each."""
    chunks = written(few_files(chunk_table(docs, id_col, text_col, window), docs), "chunks")
    own = chunks.filter("seen is null")
    # Both parts have fixed width, so equal digests combine in hash tables before the shuffle.
    first = own.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("source"),
        F.min_by("begin", "id").alias("at")).filter("n > 1").drop("n")
    flagged = own.join(first, "digest").filter(F.col("id") != F.col("source")).select(
        "id", "begin", "end", "source", "at").unionByName(
        chunks.filter("seen is not null").select(
            "id", "begin", "end", F.col("id").alias("source"), F.col("seen").alias("at")))
    # One document's chunks: bounded by its text.
    in_order = Window.partitionBy("id").orderBy("begin", "end")
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    shift = F.col("begin") - F.col("at")
    gap = F.coalesce(F.lag("end").over(in_order) != F.col("begin"), F.lit(True))
    bend = gap | (F.lag("source").over(in_order) != F.col("source")) | (
        F.lag(shift).over(in_order) != shift)
    marked = (flagged.withColumn("_gap", gap).withColumn("_bend", bend)
              .withColumn("run", F.sum(F.col("_gap").cast("int")).over(upto))
              .withColumn("line", F.sum(F.col("_bend").cast("int")).over(upto)))
    lines = marked.groupBy("id", "run", "line").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.first("source").alias("source"))
    runs = lines.groupBy("id", "run").agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"),
        F.max(F.col("end") - F.col("begin")).alias("aligned"),
        F.max_by("source", F.col("end") - F.col("begin")).alias("source"))
    return few_files(runs.filter((F.col("end") - F.col("begin") >= min_bytes)
                                 & (F.col("aligned") * 2 >= min_bytes)).select(
        F.col("id").alias(id_col), "begin", "end", "source"))


def without(text: str | None, spans) -> str | None:
    """The text without byte spans, each drawn in to white space so that words stay whole."""
    if text is None or spans is None or not len(spans):
        return text
    data = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    blank = b" \t\n\r\f\v"
    for begin, end in sorted((int(s["begin"]), int(s["end"])) for s in spans):
        while 0 < begin < end and data[begin - 1] not in blank and data[begin] not in blank:
            begin += 1
        while begin < end < len(data) and data[end - 1] not in blank and data[end] not in blank:
            end -= 1
        if begin < end:
            out.append(data[at:begin])
            at = end
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def cut(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """``docs`` with the spans removed from their texts, all columns kept, whatever their names."""
    key, found = own_name(docs, "_id"), own_name(docs, "_spans")
    per_doc = written(few_files(spans.groupBy(F.col(id_col).alias(key)).agg(
        F.collect_list(F.struct("begin", "end")).alias(found))), "spans")

    bounded_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def shorten(texts: pa.Array, spans: pa.Array) -> pa.Array:
        worker_table(None)
        return pa.array(map(without, texts.to_pylist(), spans.to_pylist()), pa.string())

    # A filter on the result would be pushed below it and run the function a second time, in a
    # Python worker more per task, which then stays alive beside the others.
    shorten = shorten.asNondeterministic()

    # Only texts with spans go through Python; the others pass beside them.
    small = broadcast_within(per_doc, at_most=_bytes(per_doc, found))
    joined = docs.join(small, docs[id_col] == small[key], "left")
    touched = joined.filter(F.col(key).isNotNull()).withColumn(
        text_col, shorten(F.col(text_col), F.col(found)))
    untouched = joined.filter(F.col(key).isNull())
    return untouched.select(*docs.columns).unionByName(touched.select(*docs.columns))


def _bytes(per_doc: DataFrame, spans: str) -> int:
    return per_doc.agg(F.coalesce(F.sum(32 + 24 * F.size(spans)), F.lit(0))).first()[0]
