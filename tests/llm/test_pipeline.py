"""The pipeline on the smallest tables: every stage against what it was given."""

import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plain_shingles(text):
    """The set of five-word shingles; words end at ASCII white space, A to Z in lower case."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \t-\r]+", low) if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_stages(spark):
    import corpus_pipeline as pipeline
    from docketry.llm import decontaminate
    from docketry.llm.common import table, written
    from docketry.llm.queries import THRESHOLD, quality_model

    docs = table(spark, SF, "documents")
    columns = docs.columns
    model = quality_model(spark, docs, SF)
    items = [decontaminate.normalise(r.text) for r in table(spark, SF, "benchmark").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and after.keys() <= before.keys()
        if name != "encoding":
            assert docs.columns == columns
        if name == "quality":
            ids = sorted(before)
            scores = dict(zip(ids, model.scores([before[i].text for i in ids])))
            assert after.keys() == {i for i in ids if scores[i] >= THRESHOLD}
        elif name == "near_duplicates":
            shingles = {i: plain_shingles(r.text) for i, r in before.items()}
            group = {i: i for i in before}
            for i in before:
                for j in before:
                    if j < i and plain_jaccard(shingles[i], shingles[j]) >= 0.8:
                        low, high = sorted((group[i], group[j]))
                        group = {k: low if g == high else g for k, g in group.items()}
            assert after.keys() == {i for i, g in group.items() if i == g}
        elif name == "substrings":
            assert all(r.n_chars == len(r.text) <= len(before[i].text) for i, r in after.items())
        elif name == "decontamination":
            texts = {i: decontaminate.normalise(r.text) for i, r in before.items()}
            assert not any(item in texts[i] for i in after for item in items)
            assert all(i in after for i in texts
                       if not any(p in texts[i] for item in items
                                  for _, p in decontaminate.pieces_of(item, int(len(item) * 0.08))))
        else:
            assert after.keys() == before.keys()
            for i, r in after.items():
                assert r.decoded_sha256 == hashlib.sha256((before[i].text or "").encode()).hexdigest()
        before = after


CLASH = ["_digest", "_key", "_least", "_gone", "_again", "_row", "_text", "_id", "_ID_", "_spans",
         "_chars", "key", "hashes", "band", "root", "size", "digest", "id", "begin", "end", "n"]
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def odd_documents():
    passage = " ".join(f"passage{i} of many" for i in range(40))
    texts = [None, "", " \n", "one", "one", passage, passage, passage + " and an end of its own",
             "before it " + passage, "x" * 3_000_000, "word " * 200_000, "ünï 日本語 " * 30]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [(5, passage, "en", "s", 1), (5, "another text of this id", "en", "s", 1),
                   (None, passage, "en", "s", 1), (None, None, None, None, None)]


@pytest.mark.parametrize("names", [[], CLASH])
def test_stages_on_odd_documents(spark, names):
    """Nulls, blanks, very long texts, repeated ids and columns of any name pass every stage."""
    import corpus_pipeline as pipeline
    from docketry.llm.common import written

    docs = spark.createDataFrame(odd_documents(), DOCS).withColumns(
        {n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    for name, stage in pipeline.STAGES:
        before = written(docs, "before")
        docs = written(stage(spark, before, SF), name)
        if name == "encoding":
            assert docs.count() == before.count()
            break
        assert docs.columns == before.columns
        for row in docs.collect():
            shown = "-" if row.doc_id is None else row.doc_id
            assert all(row[n] == f"{n}{shown}" for n in names)
        kept = [r.doc_id for r in docs.collect()]
        if name == "near_duplicates":
            assert kept.count(None) == before.filter("doc_id is null").count()
            assert kept.count(6) == 0


def test_stages_on_an_empty_table(spark):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([], DOCS)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and (name == "encoding" or out.columns == docs.columns)


def test_keep_one_by_fingerprints_keeps_columns(spark):
    from docketry.llm import simhash

    docs = spark.createDataFrame(odd_documents(), DOCS).withColumns(
        {n: F.lit(n) for n in CLASH})
    out = simhash.keep_one(docs)
    rows = out.collect()
    assert out.columns == docs.columns and all(r[n] == n for r in rows for n in CLASH)
    kept = [r.doc_id for r in rows]
    assert kept.count(None) == 2 and kept.count(5) == 2 and 6 not in kept and 4 not in kept


def test_workers_load_no_pandas():
    """Every Python worker of the stages would hold it; the modules they load do without."""
    import subprocess
    import sys

    code = ("import sys; from docketry.llm import bpe, chunks, decontaminate, quality, similar; "
            "sys.exit('pandas' in sys.modules)")
    assert subprocess.run([sys.executable, "-c", code], check=False, timeout=60).returncode == 0


def test_cut_texts_go_through_python_once(spark):
    """The filter on what is left of a text must not run the cutting again below it."""
    import corpus_pipeline as pipeline

    words = " ".join(f"w{i}x{i * 7919 % 1000}" for i in range(400))
    docs = spark.createDataFrame(
        [(1, words, "en", "a", len(words)), (2, words + " tail", "en", "a", len(words) + 5),
         (3, words, "en", "b", len(words)), (4, None, "en", "b", None), (5, " ", "en", "b", 1),
         (None, words, "en", "b", len(words))],
        "doc_id long, text string, lang string, source string, n_chars long")
    left = pipeline.substring_stage(spark, docs, SF)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    rows = {r.doc_id: r for r in left.collect()}
    assert rows.keys() == {1, 2, 4, 5, None}
    assert rows[1].text == rows[None].text == words and rows[5].text == " "
    assert 0 < rows[2].n_chars == len(rows[2].text) < 300
    assert rows[4].text is None and rows[4].n_chars is None
