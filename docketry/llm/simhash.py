"""SimHash near-duplicates, found with vantage-point trees over the fingerprints.

Words are runs of bytes other than ASCII white space after A-Z are lower-cased;
a shingle is ``shingle`` words joined by spaces, repeats included. A text with
fewer words is one shingle, a text without words (or null) has fingerprint 0.
Bit b of the fingerprint is set if it is set in more than half of the XXH64
hashes (seed 42) of the shingles. Fingerprints within ``radius`` bits link.

Two fingerprints within ``radius`` bits are within ``radius // 2`` bits in one of
their two halves, so each half has a tree, and a smaller radius means far less
overlap than a tree over all bits has. A tree is fitted on a bounded sample and
cuts the space: at vantage point v with distance m, halves with d(v, x) <= m go
inside, those with d(v, x) > m - radius outside. By the triangle inequality any
two halves within the radius of each other share a side, so they meet in a
shard; the band between is the overlap. Each shard prunes on with a tree of its
own and compares whole fingerprints exactly. A shard that holds too many rows
is dealt out as pairs of blocks.

Only distinct fingerprints travel, and a shard gives a spanning forest of its
links, never all pairs, so thousands of copies cost one row. Nulls: a null id
keeps its row; its component is the smallest id among the others, else null.
Equal rows give equal rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_within
from .common import digest_of, join_spread, map_texts, own_name, written
from .components import connected

LOWER = bytes(range(65, 91)), bytes(range(97, 123))
# The tree is fitted on at most this many distinct fingerprints (8 bytes each).
SAMPLE = 65_536
# Rows a shard should hold, and at most holds in one task.
SHARD_ROWS, CELL_ROWS = 32_768, 131_072
HALVES = (0, 32)   # lowest bit of each half


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return ones


def majority(ones: np.ndarray, total: int) -> int:
    """The fingerprint with the bits that more than half of ``total`` hashes have."""
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprint_of(data: bytes, shingle: int, hash64, to_lower: bytes) -> int:
    words = data.translate(to_lower).split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return hash64(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:n - shingle])).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    ones = np.zeros(64, np.int64)
    total = len(starts)
    for at in range(0, total, 65_536):
        ones += bit_counts(np.array([hash64(joined[a:b], 42) for a, b in
                                     zip(starts[at:at + 65_536], stops[at:at + 65_536])], np.uint64))
    return majority(ones, total)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint as a long, one row per input row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        import xxhash

        to_lower = bytes.maketrans(*LOWER)

        def run(keys, texts):
            fps = np.array([fingerprint_of((t or "").encode("utf-8", "surrogatepass"), shingle,
                                           xxhash.xxh64_intdigest, to_lower) for t in texts],
                           np.uint64)
            return [[k[0] for k in keys], fps.view(np.int64).tolist()]

        return run

    return map_texts(docs, [F.col(id_col), F.col(text_col)], f"{id_col} {id_type}, fp long", make)


def half_of(points: np.ndarray, lowest_bit: int) -> np.ndarray:
    return (points >> np.uint64(lowest_bit)) & np.uint64(0xFFFFFFFF)


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def choose_split(points: np.ndarray, radius: int, seed: int) -> tuple[np.uint64, int] | None:
    """A vantage point and distance with little overlap, or None if none saves work.

    Work is counted in pairs: a split has to leave clearly fewer than there were.
    """
    rng = np.random.default_rng(seed)
    seen = points if len(points) <= 2048 else points[rng.integers(0, len(points), 2048)]
    best, cost = None, 0.93 * len(seen) ** 2
    for vantage in seen[rng.integers(0, len(seen), 6)]:
        counts = np.bincount(distances(seen, vantage), minlength=65)
        upto = np.cumsum(counts)
        beyond = len(seen) - np.concatenate((np.zeros(radius, np.int64), upto[:65 - radius]))
        costs = upto.astype(float) ** 2 + beyond.astype(float) ** 2
        at = int(np.argmin(costs))
        if costs[at] < cost:
            best, cost = (vantage, at), costs[at]
    return best


def fit_tree(sample: np.ndarray, total: int, radius: int) -> list:
    """[vantage, distance, inside, outside] nodes; a leaf is its shard number."""
    scale = max(1.0, total / max(1, len(sample)))
    shards = 0

    def grow(points: np.ndarray, depth: int):
        nonlocal shards
        split = None
        if len(points) * scale > SHARD_ROWS and len(points) >= 32 and depth < 40:
            split = choose_split(points, radius, depth)
        if split is None:
            shards += 1
            return shards - 1
        d = distances(points, split[0])
        return [split[0], split[1], grow(points[d <= split[1]], depth + 1),
                grow(points[d > split[1] - radius], depth + 1)]

    return [grow(sample, 0)]


def shards_of(points: np.ndarray, tree: list, radius: int) -> list[tuple[int, np.ndarray]]:
    """(shard, row numbers) of every shard that some point belongs to."""
    out: list[tuple[int, np.ndarray]] = []
    stack = [(tree[0], np.arange(len(points)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if isinstance(node, int):
            out.append((node, rows))
            continue
        d = distances(points[rows], node[0])
        stack.append((node[2], rows[d <= node[1]]))
        stack.append((node[3], rows[d > node[1] - radius]))
    return out


def forest(points: np.ndarray, half: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (row, row) that join all points within ``radius`` whose halves are near as well.

    Fewer links than points: a link is kept only if it joins two groups.
    """
    labels = np.arange(len(points))
    links: list[tuple[int, int]] = []

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        near = np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            others = b[near[i]]
            mine = labels[a[i]]
            if (labels[others] == mine).all():
                continue
            roots, first = np.unique(labels[others], return_index=True)
            for root, at in zip(roots, first):
                if root != mine:
                    links.append((int(a[i]), int(others[at])))
                    labels[labels == root] = mine

    stack = [(np.arange(len(points)), 0)]
    while stack:
        rows, depth = stack.pop()
        split = (choose_split(half[rows], radius // 2, depth)
                 if len(rows) > 512 and depth < 40 else None)
        if split is None:
            for at in range(0, len(rows), 512):
                for to in range(at, len(rows), 512):
                    compare(rows[at:at + 512], rows[to:to + 512])
            continue
        d = distances(half[rows], split[0])
        stack.append((rows[d <= split[1]], depth + 1))
        stack.append((rows[d > split[1] - radius // 2], depth + 1))
    return links


def link_fingerprints(distinct: DataFrame, radius: int, sample_rows: int = SAMPLE,
                      cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b) links between the fingerprints of ``distinct`` (column ``fp``)."""
    spark = distinct.sparkSession
    total = distinct.count()
    share = min(1.0, sample_rows / max(1, total))
    picked = distinct.select("fp") if share == 1.0 else distinct.select("fp").sample(share, 17)
    sample = np.array([r[0] for r in picked.limit(sample_rows).collect()], np.int64)
    trees = [fit_tree(half_of(sample.view(np.uint64), low), total, radius // 2) for low in HALVES]
    shipped = spark.sparkContext.broadcast(trees)

    def deal(batches):
        for batch in batches:
            values = np.asarray(batch.column(0)).astype(np.int64)
            for side, low in enumerate(HALVES):
                halves = half_of(values.view(np.uint64), low)
                for shard, rows in shards_of(halves, shipped.value[side], radius // 2):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), 2 * shard + side, np.int32)),
                         pa.array(values[rows])], names=["shard", "fp"])

    dealt = written(distinct.select("fp").mapInArrow(deal, "shard int, fp long"), "shards")
    # One row per shard, and shards are bounded by the sample.
    sizes = {r[0]: r[1] for r in dealt.groupBy("shard").count()
             .filter(F.col("count") > cell_rows).collect()}
    cell = F.lit(0).cast("long")
    if sizes:
        blocks = F.coalesce(F.element_at(F.create_map(*[
            F.lit(v) for k, n in sizes.items() for v in (k, -(-2 * n // cell_rows))]),
            F.col("shard")), F.lit(1))
        dealt = dealt.withColumn("_g", blocks).withColumn(
            "_b", F.pmod(F.xxhash64("fp"), F.col("_g")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
        dealt = dealt.select("shard", "fp", "_b", other.alias("_o"))
        cell = (F.least("_b", "_o").cast("long") * 1_000_000 + F.greatest("_b", "_o"))
    dealt = dealt.select("shard", cell.alias("cell"), "fp")

    def links(rows: pa.Table) -> pa.Table:
        values = rows.column("fp").to_numpy()
        low = HALVES[rows.column("shard")[0].as_py() % 2]
        pairs = forest(values.view(np.uint64), half_of(values.view(np.uint64), low), radius)
        ends = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"a": values[ends[:, 0]], "b": values[ends[:, 1]]})

    return dealt.groupBy("shard", "cell").applyInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id, fingerprint hex, component_id), one row per document."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = written(prints.groupBy("fp").agg(
        F.min(id_col).alias("least"), F.count(F.lit(1)).alias("rows")), "distinct")
    links = written(link_fingerprints(distinct, radius), "links")
    least = distinct
    roots = connected(links)
    if roots is not None:
        named = written(distinct.join(roots, distinct["fp"] == roots["node"]).select(
            "fp", "least", "root"), "rooted")
        smallest = written(named.groupBy("root").agg(
            F.min("least").alias("smallest"), F.count(F.lit(1)).alias("prints")), "smallest")
        moved = join_spread(named.select("fp", "root"), smallest, "root", "prints")
        least = written(distinct.join(moved.select("fp", "smallest"), "fp", "left").select(
            "fp", F.coalesce("smallest", "least").alias("least"), "rows"), "least")
    # A fingerprint may be that of a third of all rows.
    return join_spread(prints, least, "fp", "rows").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents without those that a smaller id of their component stands for.

    Rows with a null id cannot be named and stay. Rows that repeat an id are judged
    each by its own text; of a component's rows the one with the least (id, digest of
    the text) stays, and of rows with equal ids and texts the first by other columns.
    """
    digest, gone, text, again, number = (own_name(docs, n) for n in (
        "_digest", "_gone", "_text", "_again", "_row"))
    rows = docs.withColumn(digest, digest_of(text_col))
    row = F.struct(F.col(id_col).alias("id"), F.col(digest).alias("digest"))
    named = rows.filter(F.col(id_col).isNotNull()).select(
        row.alias("row"), F.col(text_col).alias("body"))
    found = near_duplicates(named, "row", "body", shingle, radius)
    out = written(found.filter("row <> component_id").select(
        F.col("row.id").alias(gone), F.col("row.digest").alias(text)).distinct(), "gone")
    kept = rows.join(broadcast_within(out), (rows[id_col] == F.col(gone))
                     & (rows[digest] == F.col(text)), "left_anti")
    several = (rows.filter(F.col(id_col).isNotNull()).groupBy(id_col, digest).count()
               .filter("count > 1").select(F.col(id_col).alias(again), F.col(digest).alias(text)))
    several = written(several, "again")
    if several.isEmpty():
        return kept.select(*docs.columns)
    same = (kept[id_col] == F.col(again)) & (kept[digest] == F.col(text))
    once = kept.join(several, same, "left_semi").withColumn(number, F.row_number().over(
        Window.partitionBy(id_col, digest).orderBy(
            text_col, F.xxhash64(*docs.columns)))).filter(F.col(number) == 1)
    return kept.join(several, same, "left_anti").select(*docs.columns).unionByName(
        once.select(*docs.columns))
