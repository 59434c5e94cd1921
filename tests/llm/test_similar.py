"""Near-duplicates of the pipeline by five-word shingles, against all pairs."""

import random

import pytest

from docketry.llm import simhash, similar

from .test_operators import docs, plain_fingerprint, texts, words  # noqa: F401


def plain_similarity(a, b):
    sets = []
    for text in (a, b):
        data = (text or "").encode().translate(bytes.maketrans(*simhash.LOWER)).split()
        sets.append({tuple(data[i:i + 5]) for i in range(max(1, len(data) - 4))} if data else set())
    union = len(sets[0] | sets[1])
    return len(sets[0] & sets[1]) / union if union else 1.0


@pytest.mark.parametrize("stars, block", [(0, 16), (1, 128), (2, 128), (4, 16)])
def test_edited_copies_go(spark, stars, block, monkeypatch):
    """Copies with edits that SimHash within 3 bits does not find, against all pairs."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "CELL", block)
    rng = random.Random(3)
    made = ["", " \n", None, "One two", "one  TWO", "one three"]
    for base in range(6):
        text = words(100 + base, 300).split()
        made.append(" ".join(text))
        for edits in range(1, 16):
            copy = list(text)
            for at in rng.sample(range(300), edits):
                copy[at] = f"new{rng.random()}"
            made.append(" ".join(copy))
    root = list(range(len(made)))
    edited = 0
    for i in range(len(made)):
        for j in range(i):
            if plain_similarity(made[i], made[j]) >= 0.8:
                edited += (plain_fingerprint(made[i]) ^ plain_fingerprint(made[j])).bit_count() > 3
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert edited > 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    got = [r.doc_id for r in similar.keep_one(df, stars=stars).collect()]
    assert sorted(got) == [i for i, r in enumerate(root) if i == r]


def test_edited_copies_of_repeated_ids(spark, docs):  # noqa: F811
    rows = [(1, words(50, 40)), (1, words(51, 40)), (2, words(51, 40)), (2, words(52, 40)),
            (2, words(52, 40)), (None, words(50, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text) for r in similar.keep_one(df).collect()))
    assert got == sorted([(0, rows[0][1]), rows[0], rows[1], rows[3]])
    kept = [r.doc_id for r in similar.keep_one(docs).collect()]
    assert kept.count(None) == 2 and kept.count(6) == 1 and not {1, 2, 4, 7, 9} & set(kept)


def test_trees_of_fingerprints_find_candidates(spark):
    """Near copies that share no band are linked through the trees; others they meet are not."""
    from pyspark.sql import functions as F

    from docketry.llm.common import written

    text = words(7, 3000)
    made = [text, text + " end", " ".join([*text.split()[:-1], "other"]), words(8, 300), "One two"]
    assert all((plain_fingerprint(made[0], 5) ^ plain_fingerprint(made[i], 5)).bit_count() <= 3
               for i in (1, 2))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    nodes = written(similar.banded(df, "doc_id", "text", 5).withColumn(
        "bands", F.array("id")).withColumnRenamed("id", "least"), "nodes")
    roots = similar.similar_links(df, nodes, "text", 5, 0.8).collect()
    least = {r.key: r.least for r in nodes.collect()}
    assert sorted(least[r.node] for r in roots) == [0, 1, 2]
    assert len({r.root for r in roots}) == 1
    # Texts of one fingerprint are candidates only: their similarity decides.
    alike = written(nodes.withColumn("fp", F.lit(5).cast("long")), "alike")
    assert similar.tree_pairs(alike, 0.8).count() == 2
    far = written(nodes.filter("least in (3, 4)").withColumn("size", F.lit(9)).withColumn(
        "fp", F.lit(5).cast("long")), "far")
    assert similar.tree_pairs(far, 0.8).count() == 1
    assert similar.similar_links(df, far, "text", 5, 0.8) is None
