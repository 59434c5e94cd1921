import random

from pyspark.sql import functions as F

from docketry import fixed_values as fixed
from docketry.functions import text as T


def test_white_space_set_is_complete():
    assert set(T.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip_and_has_text(one):
    texts = [" a b\t", "  x　", "\x1f\x1c", "", None, "﻿z"]
    assert one(T.strip, texts) == ["a b", "x", "", "", None, "﻿z"]
    assert one(T.has_text, texts) == [True, True, False, False, False, True]


def test_snippet_counts_code_points(one):
    text = "é😀" * 300
    assert one(T.snippet, [text, "ab"]) == [text[:500], "ab"]
    assert one(T.display_snippet, [text, "a" * 500]) == [text[:500] + "...", "a" * 500]


def test_score_percent_rounds_like_c(one):
    rng = random.Random(1)
    scores = [0.0, 1.0, 0.0625, 0.3125, 0.0015, 0.0115, 0.2345, 0.99949, 0.9995, 1e-9]
    scores += [rng.random() for _ in range(500)] + [i / 2000 for i in range(2001)]
    assert one(T.score_percent, scores, "double") == [f"{s * 100:.1f}%" for s in scores]


def test_estimate_tokens(one):
    assert one(T.estimate_tokens, ["", "a", "abcd", "abcde", "a" * 400]) == [1, 1, 1, 2, 100]


def test_truncation(one):
    texts = ["a" * 10, "a" * 11]
    assert one(lambda t: T.truncate_text(t, 10), texts) == ["a" * 10] * 2
    assert one(lambda t: T.is_truncated(t, 10), texts) == [False, True]


def test_result_key(one):
    name, date = F.lit("A v B"), F.lit("2020")
    assert one(lambda u: T.result_key(u, name, date), ["u", "", None]) == [
        "u", "rank-1:A v B:2020", "rank-1:A v B:2020"]
    assert one(lambda u: T.result_key(u, name, date, "x", False), ["u"]) == [
        "u|backend=x|fast_mode=False"]


def test_prompts(one):
    assert one(T.embed_prompt, ["q"])[0].endswith("decisions\nQuery:q")
    assert one(T.rerank_query, ["q"]) == [fixed.RERANKER_INSTRUCTION + "\nq"]
    assert "<Query>: q\n<Document>: d" in one(lambda q: T.rerank_prompt(q, F.lit("d")), ["q"])[0]
    plain, grounded = (one(lambda t, g=g: T.card_prompt(t, 3, g), ["abcdef"])[0]
                       for g in (False, True))
    assert "decision:\n\nabc<|im_end|>" in plain and "[Source:" not in plain
    assert "[Source: para X-Y | explicit]" in grounded
