"""What the substring stage drops and what it passes."""

from .test_operators import words


def test_only_texts_cut_to_nothing_go(spark):
    import corpus_pipeline as pipeline

    text = words(1, 200)
    blank = " \t\n"
    rows = [(1, text, -1), (2, text, -1), (3, blank, -1), (4, "", -1), (5, None, -1),
            (6, f"  {text}\n", -1), (7, f"{text}\nA line of its own.", -1), (None, blank, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.substring_stage(spark, docs, "").collect()}
    # Texts without spans pass untouched; of 2 the cut leaves the empty string.
    for doc, text, n_chars in rows:
        if doc in (1, 3, 4, 5, None):
            assert got.pop(doc) == (text, n_chars)
    assert 2 not in got and got.keys() <= {6, 7} and 7 in got
    for text, n_chars in got.values():
        assert text.strip() and n_chars == len(text)
