"""Spans and languages against plain versions; empty tables and very long texts."""

import base64
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from docketry.llm import bpe, chunks, decontaminate, language, tokens

from .test_operators import DOCS, P, plain_count, words


# --- 8: substrings ----------------------------------------------------------------------------

def plain_spans(texts, window=chunks.WINDOW, min_bytes=chunks.MIN_BYTES):
    """{(id, begin, end)} of a table whose ids are unique, by dictionaries over all chunks."""
    parts = {}
    for doc, text in texts.items():
        data = (text or "").encode()
        cuts = chunks.cuts_of_many([data], window)[0]
        parts[doc] = [(data[max(0, a - chunks.REACH):b], a, b)
                      for a, b in zip(cuts, [*cuts[1:], len(data)])]
    first = {}
    for doc in sorted(parts):
        for value, a, _ in parts[doc]:
            first.setdefault(value, (doc, a))
    found = set()
    for doc, each in parts.items():
        own, run = {}, []
        for value, a, b in [*each, (None, None, None)]:
            at = None
            if value is not None:
                if value in own:                  # again in its own text
                    at = (doc, own[value])
                else:
                    own[value] = a
                    at = first[value] if first[value][0] != doc else None
            if at is not None:
                run.append((a, b, at))
                continue
            if run:
                aligned, start = 0, 0
                for i in range(1, len(run) + 1):
                    if i == len(run) or (run[i][2][0], run[i][0] - run[i][2][1]) != (
                            run[start][2][0], run[start][0] - run[start][2][1]):
                        aligned = max(aligned, run[i - 1][1] - run[start][0])
                        start = i
                begin, end = run[0][0], run[-1][1]
                if end - begin >= min_bytes and 2 * aligned >= min_bytes:
                    found.add((doc, begin, end))
            run = []
    return found


def test_spans_are_those_of_dictionaries(spark):
    rng = random.Random(5)
    pool = [words(400 + i, rng.randint(10, 90), "abcdefghijklmnop") for i in range(12)]
    texts = {}
    for n in range(80):
        body = [words(n * 10 + i, rng.randint(5, 60), "abcdefghijklmnop") for i in range(3)]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(pool)
            if rng.random() < 0.3:
                passage = passage.replace("a", "ä", 1)
            body.insert(rng.randint(0, len(body)), passage)
        texts[n] = " ".join(body)
    texts[80], texts[81], texts[82] = texts[3], "z" * 20_000, None
    texts[83] = words(9000, 40_000) + pool[0] + pool[1]
    texts[84] = texts[83][100:150_000]
    rows = [(i, t, "en", "s", 1) for i, t in texts.items()]
    got = chunks.repeated_spans(spark.createDataFrame(rows, DOCS)).collect()
    want = plain_spans(texts)
    assert {(r.doc_id, r.begin, r.end) for r in got} == want and len(got) == len(want)
    assert len(want) > 20 and any(d == 84 and e - b > 100_000 for d, b, e in want)


# --- 4: language ------------------------------------------------------------------------------

def plain_grams(text):
    s = "".join(c if c.isalpha() else " " for c in "  " + text.lower() + "  ")
    return [s[i:i + n] for n in (3, 4) for i in range(len(s) - n + 1)
            if all(c != " " for c in s[i + 1:i + n - 1])]


def test_languages_are_those_of_plain_sets(spark):
    rng = random.Random(12)
    alphabets = {"aa": "abcdefg", "bb": "cdefghi", "cc": "efgxyzéè"}
    rows = [(i, words(i, rng.randint(30, 80), alphabets[lang]) + " 12!", lang, "s", 1)
            for i, lang in enumerate(list(alphabets) * 30)]
    df = spark.createDataFrame(rows, DOCS)
    counts = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        counts[lang].update(plain_grams(text))
    got = defaultdict(list)
    for r in language.gram_counts(df, "lang", "text").collect():
        got[r.lang].append(r.n)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(c.values()) for k, c in counts.items()}

    share, ratio = 1e-4, 3.0
    model = language.fit(df, min_share=share, ratio=ratio)
    assert model.languages == sorted(counts, key=lambda k: (-counts[k].total(), k))
    part = {k: {g: n / c.total() for g, n in c.items() if n / c.total() >= share} for k, c in counts.items()}
    held = {k: {g for g, s in own.items()
                if s * ratio >= max(o.get(g, 0) for o in part.values())} for k, own in part.items()}
    tests = [words(5000 + i, 200, rng.choice(list(alphabets.values()))) for i in range(40)]
    names, scores = model.predict(tests)
    clear = 0
    for text, name, score in zip(tests, names, scores):
        grams = plain_grams(text)
        exact = np.array([sum(g in held[k] for g in grams) for k in model.languages], float)
        hits = model.hits(language.grams_of([text])[0]).sum(axis=0)
        assert (hits >= exact).all()
        real = np.maximum(0, (hits - len(grams) * model.chance) / (1 - model.chance))
        assert np.abs(real - exact).max() <= 0.03 * len(grams)
        second, best = np.sort(exact)[-2:]
        if best - second > 0.06 * len(grams):
            clear += 1
            assert name == model.languages[int(exact.argmax())]
            assert score == pytest.approx(best / exact.sum(), abs=0.06)
    assert clear > 20


def test_ties_of_languages_go_to_the_lesser_name(spark):
    rows = [(1, "abc abc", "zz", "s", 1), (2, "xyz xyz", "bb", "s", 1)]
    model = language.fit(spark.createDataFrame(rows, DOCS))
    assert model.languages == ["bb", "zz"]
    assert model.predict(["qqq", "abc xyz"])[0] == ["bb", "bb"]


# --- empty tables, very long texts ------------------------------------------------------------

def test_tokens_and_bpe_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert tokens.token_counts(empty, P.path("piece_bpe_32k.model")).collect() == []
    assert bpe.encode_texts(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect() == []


def test_very_long_texts(spark):
    item = words(77, 40)
    text = words(1, 150_000) + " " + item + " " + words(2, 150_000) + "\n" + "y" * 200_000
    df = spark.createDataFrame([(1, text, "aa", "s", 1), (2, words(3, 50), "aa", "s", 1)], DOCS)
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == {(1, 9)}
    found = language.identify(df, language.fit(df)).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in found) == [(1, "aa"), (2, "aa")]

    path = P.path("piece_bpe_32k.model")
    pieces, byte_scores = tokens.zipf_scores(path)
    long = words(2, 40_000) + " " + "ab" * 2000
    own = spark.createDataFrame([(1, long, "aa", "s", 1)], DOCS)
    (row,) = tokens.token_counts(own, path).collect()
    known = {w: plain_count(w, pieces, byte_scores) for w in set(long.split())}
    each = [known[w] for w in long.split()]
    assert (row.n_words, row.n_tokens) == (len(each), sum(n for n, _ in each))


def test_bpe_of_a_very_long_text(spark):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = words(6, 300_000) + " <|endoftext|> " + "é" * 3000
    df = spark.createDataFrame([(1, text, "aa", "s", 1)], DOCS)
    (row,) = bpe.encode_texts(df, path, P.PATTERN, with_ids=True).collect()
    assert row.ids == exact.encode_ordinary(text)
