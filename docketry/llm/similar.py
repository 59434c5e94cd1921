"""Near-duplicates by SimHash trees and the Jaccard similarity of word shingles, for the pipeline's stage.

Words are those of ``simhash``; a text is the set of its ``shingle``-word shingles,
a text with fewer words is one shingle. Two texts link if their sets share at least
``similarity`` of their union, counted exactly from 64-bit hashes; texts without
words (or null) link to each other only.

Candidates come from the trees of ``simhash`` first: every text has the fingerprint of its
shingles, repeats included; texts of one fingerprint are held against one of them, and
these against each other where the trees link their fingerprints (``RADIUS`` bits). Edited
copies often lie beyond any radius at which trees prune, so further candidates, among texts
that are still apart, share a band: ``ROWS`` of the least values of the set under ``BANDS`` x
``ROWS`` multipliers. A pair at similarity 0.8 misses all bands with probability
(1 - 0.8 ** 4) ** 20, about 3 in 100,000, and less above. Only links found among
candidates count, so there are no false ones.

A text is known by its MD5 digest, whatever ids it has. Sizes of the sets go first:
a pair whose smaller set is less than 0.8 of the larger one is no candidate. A band's
members are held against one of them, the one with the least id and then another by
hash, so that a large group costs a row per member. Bands that still have members in
different components go in blocks: a task holds the sets of two blocks, joins what it finds by
union and leaves out pairs already joined, so that pairs of texts unlike each other
are all that is compared one by one, and no pair is a row.
Of every component the row with the least (id, digest) stays. Of rows with this id
and text the first by its other columns stays. Rows with a null id stay, and stand
for no other. Null texts are like texts without words. Columns of any name are kept;
an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sizes import broadcast_within
from .common import (bounded_batches, digest_of, few_files, give_back, join_spread, map_texts,
                     own_name, worker_table, written)
from .components import connected
from .simhash import LOWER, bit_counts, link_fingerprints, majority

SHINGLE, SIMILARITY = 5, 0.8
# Bits that fingerprints linked by the trees differ in, at most.
RADIUS = 3
BANDS, ROWS = 20, 4
# Rounds that hold a band's members against one of them, members of a task that meet one, and
# members of a block.
STARS, CELL, BLOCK = 2, 1_024, 128

MULTIPLIERS = np.random.default_rng(42).integers(
    0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_hashes(data: bytes, shingle: int, hash64, to_lower: bytes) -> np.ndarray:
    """Hashes of the shingles in their order, repeats included."""
    words = data.translate(to_lower).split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([hash64(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:n - shingle])).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    return np.fromiter((hash64(joined[a:b], 42) for a, b in zip(starts, stops)),
                       np.uint64, len(starts))


def shingle_set(data: bytes, shingle: int, hash64, to_lower: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(data, shingle, hash64, to_lower))


def bands_of(hashes: np.ndarray, hash64) -> list[int]:
    """One signed 64-bit key per band; texts without words share one band."""
    if not len(hashes):
        return [0]
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (MULTIPLIERS[:, None] * hashes[None, at:at + 4096]).min(axis=1),
                   out=least)
    keys = [hash64(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - shared
    return shared / union if union else 1.0


def banded(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, key, size, fp, bands), one row per row with an id; size counts distinct shingles."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        import xxhash

        to_lower = bytes.maketrans(*LOWER)

        def run(keys, texts):
            sizes, prints, found = [], [], []
            for t in texts:
                every = shingle_hashes((t or "").encode("utf-8", "surrogatepass"), shingle,
                                       xxhash.xxh64_intdigest, to_lower)
                hashes = np.unique(every)
                sizes.append(len(hashes))
                prints.append(majority(bit_counts(every), len(every)))
                found.append(bands_of(hashes, xxhash.xxh64_intdigest))
            return [[k[0] for k in keys], [k[1] for k in keys], sizes,
                    np.array(prints, np.uint64).view(np.int64).tolist(), found]

        return run

    return map_texts(docs.filter(F.col(id_col).isNotNull()),
                     [F.col(id_col), digest_of(text_col), F.col(text_col)],
                     f"id {id_type}, key binary, size int, fp long, bands array<bigint>", make)


def sets_of(texts: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(key, hashes): the packed shingle set of every text, made once."""
    def make():
        import xxhash

        to_lower = bytes.maketrans(*LOWER)

        def run(keys, bodies):
            return [[k[0] for k in keys],
                    [shingle_set((t or "").encode("utf-8", "surrogatepass"), shingle,
                                 xxhash.xxh64_intdigest, to_lower).tobytes() for t in bodies]]

        return run

    return map_texts(texts, [F.col("key"), F.col(text_col)], "key binary, hashes binary", make)


def near_sizes(a, b, similarity: float):
    """Whether sets of these sizes can be similar enough, as columns."""
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)


def star_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) pairs of keys whose sets are similar enough.

    A set a is sent once for every ``CELL`` of its members b, ahead of them, so a
    task holds one set a, whatever the number of its members.
    """
    bounded_batches(pairs.sparkSession)
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells"))
    dealt = pairs.join(broadcast_within(counts), "a").withColumn(
        "cell", F.pmod(F.xxhash64("b"), F.col("cells")))
    none = F.lit(None).cast("binary")
    centres = dealt.select("a", "cell").distinct().join(
        sets.select(F.col("key").alias("a"), "hashes"), "a").select("a", "cell", none.alias("b"), "hashes")
    members = dealt.select("a", "cell", "b").join(
        sets.select(F.col("key").alias("b"), "hashes"), "b").select("a", "cell", "b", "hashes")

    def run(batches):
        worker_table(None)
        held = None
        for batch in batches:
            a, b = [], []
            for key, member, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                hashes = np.frombuffer(data, np.uint64)
                if member is None:
                    held = hashes
                elif similarity_of(held, hashes) >= similarity:
                    a.append(key)
                    b.append(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        give_back()

    ordered = centres.unionByName(members).repartition("a", "cell").sortWithinPartitions(
        "a", "cell", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(run, "a binary, b binary")


def block_links(open_bands: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between members of a band that lie in different components, a forest a task.

    ``open_bands``: band, key, root, size, each band with all its members. They go in blocks of
    about ``BLOCK``; two blocks meet in a task, which leaves out pairs that it has
    joined and pairs whose sizes differ too much.
    """
    bounded_batches(open_bands.sparkSession)
    # Bands with the same members are compared once.
    alike = open_bands.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("sum"))
    once = alike.groupBy("n", "sum").agg(F.min("band").alias("band")).select(
        "band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = open_bands.join(broadcast_within(written(few_files(once), "once")), "band").withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    cells = dealt.select("band", F.explode(meets).alias("cell"), "block", "key", "root").select(
        "band", "cell.i", "cell.j", "block", "key", "root").join(sets, "key").select(
        "band", "i", "j", "block", "key", "root", "hashes")

    def links_of(rows: list[tuple]) -> list[tuple]:
        first = rows[0][0]
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        lone = all(r[0] == first for r in rows)
        for at, (block, key, own, hashes) in enumerate(rows):
            for other, right, theirs, more in rows[at + 1:]:
                small, large = sorted((len(hashes), len(more)))
                if not lone and block == other or small < similarity * large:
                    continue
                x, y = root(own), root(theirs)
                if x != y and similarity_of(hashes, more) >= similarity:
                    parent[max(x, y)] = min(x, y)
                    out.append((key, right))
        return out

    def run(batches):
        worker_table(None)
        now, held = None, []

        def found():
            links = links_of(held) if held else []
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.binary()),
                 pa.array([y for _, y in links], pa.binary())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for band, i, j, block, key, root, data in zip(*columns):
                if (band, i, j) != now:
                    yield found()
                    now = band, i, j
                held.append((block, key, root, np.frombuffer(data, np.uint64)))
        yield found()
        give_back()

    # Every cell is whole in one task; equal cells are told apart by their order.
    ordered = cells.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "block", "key")
    return ordered.mapInArrow(run, "a binary, b binary")


def tree_pairs(nodes: DataFrame, similarity: float, radius: int = RADIUS) -> DataFrame:
    """(a, b) candidate pairs of keys: one fingerprint, or fingerprints that the trees link.

    ``nodes``: key, least, size, fp, a written table. A fingerprint is stood for by the text
    with the least id; no more pairs come out than there are texts and links of the trees.
    """
    text = F.min_by(F.struct("key", "size"), F.struct("least", "key"))
    prints = written(few_files(nodes.groupBy("fp").agg(
        text.alias("_c"), F.count(F.lit(1)).alias("texts"))), "prints")
    links = written(few_files(link_fingerprints(prints.select("fp"), radius)), "near")
    ends = [prints.select(F.col("fp").alias(end), F.col("_c").alias(f"_{end}")) for end in "ab"]
    near = links.join(broadcast_within(ends[0]), "a").join(broadcast_within(ends[1]), "b").select(
        F.col("_a").alias("x"), F.col("_b").alias("y"))
    same = join_spread(nodes.select("fp", F.struct("key", "size").alias("y")), prints, "fp",
                       "texts").select(F.col("_c").alias("x"), "y")
    return near.unionByName(same).filter(
        (F.col("x.key") != F.col("y.key"))
        & near_sizes(F.col("x.size"), F.col("y.size"), similarity)).select(
        F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def similar_links(docs: DataFrame, nodes: DataFrame, text_col: str, shingle: int,
                  similarity: float, stars: int = STARS) -> DataFrame | None:
    """(node, root) of all keys that link to another, None without links."""
    members = nodes.select("key", "least", "size", F.explode(F.array_distinct("bands")).alias("band"))
    several = written(few_files(members.groupBy("band").count().filter("count > 1").select("band")),
                      "bands")
    shared = written(few_files(members.join(broadcast_within(several), "band", "left_semi")),
                     "members")
    near = written(few_files(tree_pairs(nodes, similarity)), "near_pairs")
    wanted = written(few_files(shared.select("key").unionByName(near.select(
        F.col("a").alias("key"))).unionByName(near.select(F.col("b").alias("key"))).distinct()),
        "wanted")
    digest = own_name(docs, "key")
    bodies = docs.select(digest_of(text_col).alias(digest), F.col(text_col).alias("text")).join(
        broadcast_within(wanted.select(F.col("key").alias(digest))), digest, "left_semi")
    sets = written(few_files(sets_of(bodies.select(F.col(digest).alias("key"), "text"), "text",
                                     shingle).groupBy("key").agg(
        F.any_value("hashes").alias("hashes")), docs), "sets")
    links = [written(few_files(star_links(near, sets, similarity)), "links")]
    roots = connected(links[0])
    for turn in range(stars + 1):
        now = shared.withColumn("root", F.col("key")) if roots is None else shared.join(
            broadcast_within(roots.select(F.col("node").alias("key"), "root")), "key",
            "left").withColumn("root", F.coalesce("root", "key"))
        open_bands = now.groupBy("band").agg(
            F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        now = written(few_files(now.join(broadcast_within(
            written(few_files(open_bands.select("band")), "open")), "band", "left_semi")), "now")
        if now.isEmpty():
            break
        if turn == stars:
            found = block_links(now, sets, similarity)
        else:
            order = F.struct("least", "key") if turn == 0 else F.struct(
                F.xxhash64("key", F.lit(turn)), "key")
            centres = now.groupBy("band").agg(
                F.min_by(F.struct("key", "root", "size"), order).alias("_c"))
            pairs = now.join(broadcast_within(centres), "band").filter(
                (F.col("root") != F.col("_c.root"))
                & near_sizes(F.col("size"), F.col("_c.size"), similarity)).select(
                F.col("_c.key").alias("a"), F.col("key").alias("b"))
            found = star_links(written(few_files(pairs.distinct()), "pairs"), sets, similarity)
        links.append(written(few_files(found), "links"))
        roots = connected(reduce(DataFrame.unionByName, links))
    return roots


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, similarity: float = SIMILARITY,
             stars: int = STARS) -> DataFrame:
    """The documents without those that a smaller id of their component stands for."""
    rows = written(few_files(banded(docs, id_col, text_col, shingle), docs), "banded")
    # Equal texts combine before the shuffle; equal rows are counted apart from them.
    held = written(few_files(rows.groupBy("key", "id").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("size").alias("size"),
        F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")).groupBy("key").agg(
        F.min("id").alias("least"), F.max("id").alias("most"), F.min_by("n", "id").alias("n"),
        F.any_value("size").alias("size"), F.any_value("fp").alias("fp"),
        F.any_value("bands").alias("bands"))), "texts")
    roots = similar_links(docs, held, text_col, shingle, similarity, stars)
    judged = held.select("key", "least", "most", "n", F.lit(False).alias("gone"))
    if roots is not None:
        named = held.drop("bands").join(
            broadcast_within(roots.withColumnRenamed("node", "key")), "key", "left")
        first = named.filter("root is not null").groupBy("root").agg(
            F.min(F.struct("least", "key"))["key"].alias("first"))
        judged = named.join(broadcast_within(first), "root", "left").select(
            "key", "least", "most", "n",
            F.coalesce(F.col("key") != F.col("first"), F.lit(False)).alias("gone"))
    # Texts that one row holds and that stay need no verdict.
    key, least, gone, again, digest, row = (own_name(docs, n) for n in (
        "_key", "_least", "_gone", "_again", "_digest", "_row"))
    judged = written(few_files(judged.filter("gone or least <> most or n > 1").select(
        F.col("key").alias(key), F.col("least").alias(least), F.col("gone").alias(gone),
        (~F.col("gone") & (F.col("n") > 1)).alias(again))), "judged")
    joined = docs.withColumn(digest, digest_of(text_col)).join(
        broadcast_within(judged), F.col(digest) == F.col(key), "left")
    kept = joined.filter(F.col(id_col).isNull() | F.col(key).isNull()
                         | (~F.col(gone) & (F.col(id_col) == F.col(least))))
    if judged.filter(F.col(again)).isEmpty():
        return kept.select(*docs.columns)
    several = F.col(id_col).isNotNull() & F.coalesce(again, F.lit(False))
    once = kept.filter(several).withColumn(row, F.row_number().over(
        Window.partitionBy(digest, id_col).orderBy(
            text_col, F.xxhash64(*docs.columns)))).filter(F.col(row) == 1)
    return kept.filter(~several).select(*docs.columns).unionByName(once.select(*docs.columns))
