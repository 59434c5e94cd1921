"""The training sample of the quality model on long documents and repeated ids."""

import numpy as np

from docketry.llm import quality

from .test_operators import words


def line(seed, good):
    text = words(seed, 8)
    return text.capitalize() + "." if good else text.upper().replace(" ", "!! ")


def labelled(spark, n=60):
    rows = [(i, "\n".join(line(i * 9 + j, i % 3) for j in range(6))) for i in range(n)]
    labels = [(i, int(i % 3 > 0)) for i in range(n)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int")


def test_a_long_document_displaces_no_other(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows, labels = labelled(spark)
    first = labels.orderBy(F.xxhash64("doc_id")).first()
    long = "\n".join(line(j, first.quality) for j in range(700))
    rows[first.doc_id] = (first.doc_id, long)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    fit_lines = quality.fit_lines
    monkeypatch.setattr(quality, "fit_lines", lambda x, n, y: seen.append(n) or fit_lines(x, n, y))
    for most in (500, 1000):
        model = quality.fit(df, labels, sample_lines=most)
        got = {r.doc_id: r.score >= 0.3 for r in quality.score(df, model).collect()}
        assert got == {i: i % 3 > 0 for i, _ in rows}
        assert len(seen[-1]) == 60 and most - 60 < seen[-1].sum() <= most
    quality.fit(df, labels)
    assert seen[-1].sum() == 700 + 59 * 6


def test_fair_lines():
    rng = np.random.default_rng(1)
    for total in (50, 90, 1000, 10 ** 6):
        sizes = rng.integers(1, 400, 50)
        most = quality.fair_lines(sizes, total)
        assert np.minimum(sizes, most).sum() <= total
        assert most == sizes.max() or np.minimum(sizes, most + 1).sum() > total


def test_repeated_ids_are_one_document(spark, monkeypatch):
    rows, labels = labelled(spark)
    rows += [(7, rows[7][1])] * 400 + [(8, f"{rows[8][1]}\n{i}") for i in range(400)]
    rows += [(None, "x"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    fit_lines = quality.fit_lines
    monkeypatch.setattr(quality, "fit_lines", lambda x, n, y: seen.append(n) or fit_lines(x, n, y))
    models = [quality.fit(part, labels, sample_lines=400)
              for part in (df, df.repartition(7, "text"))]
    assert [len(n) for n in seen] == [60, 60] and (seen[0] == seen[1]).all()
    assert np.allclose(models[0].weights, models[1].weights)
