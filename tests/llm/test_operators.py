"""Each operator against a brute-force version, and on nulls, blanks, repeats and empty tables."""

import base64
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docketry.llm import (bpe, chunks, components, decontaminate, language, quality, simhash,
                          tokens, topk, urls, warc)
from docketry.llm.common import scratch

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, alphabet="abcdefgh"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = words(1, 200)
    near = base.split()
    near[100] = "changed"
    long = words(2, 30_000)
    return [None, "", " \t\n", "One", "one", "Two words", base, base, " ".join(near), base.upper(),
            words(3, 80), "ünï " * 50, "a" * 5000, long, "日本語 テキスト", "\u00a0x\u2003y",
            "I'll don't 123  456\n\n\nx", words(4, 3), "a.b,c!!"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(6, texts[6], "en", "s", 1), (None, texts[6], "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns(
        {c: F.lit("clash") for c in ("fp", "digest", "id", "begin", "_c0", "least", "number")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1: SimHash ---------------------------------------------------------------------

def plain_fingerprint(text, shingle=3):
    data = (text or "").encode().translate(bytes.maketrans(*simhash.LOWER)).split()
    if not data:
        return 0
    parts = [b" ".join(data[i:i + shingle]) for i in range(max(1, len(data) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs, texts):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    prints = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if bin(prints[i] ^ prints[j]).count("1") <= 3:
                    root[i] = min(root[i], root[j])
    for row in got:
        if row.doc_id is not None:
            assert int(row.fingerprint, 16) == prints[row.doc_id] and len(row.fingerprint) == 16
            assert row.component_id == root[row.doc_id]
    assert {r.component_id for r in got if r.doc_id is None} == {0, 6}


def test_spark_hash_is_the_same(spark, docs, texts):
    row = docs.filter("doc_id = 5").select(F.xxhash64(F.lower("text")).alias("h")).first()
    assert row.h & (1 << 64) - 1 == plain_fingerprint(texts[5])


@pytest.mark.parametrize("n,near", [(1, 0), (600, 100), (6000, 2500)])
def test_trees_lose_no_link(spark, n, near):
    rng = np.random.default_rng(n)
    points = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for i in range(near):      # chains of near fingerprints, some in dense balls
        flips = rng.integers(0, 64, rng.integers(1, 4), dtype=np.uint64)
        points[n - 1 - i] = points[rng.integers(0, max(1, near // 20))]
        for f in flips:
            points[n - 1 - i] ^= np.uint64(1) << f
    points = np.unique(points)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    got = components.connected(simhash.link_fingerprints(df, 3, sample_rows=500, cell_rows=700))
    root = {}
    label = np.arange(len(points))
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 3):
            if label[j] != label[i]:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
    want = {}
    for i, x in enumerate(label):
        want.setdefault(x, set()).add(int(points.view(np.int64)[i]))
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    for row in (got.collect() if got is not None else []):
        root.setdefault(row.root, set()).add(row.node)
    assert {frozenset(v) for v in root.values()} == want


def test_keep_one(docs):
    kept = sorted((r.doc_id for r in simhash.keep_one(docs).collect() if r.doc_id is not None))
    assert len(kept) == len(set(kept)) and 6 in kept
    assert not {1, 2, 4, 7, 9} & set(kept) and 0 in kept


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components.connected(
        spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- 2: top-k ------------------------------------------------------------------------

@pytest.mark.parametrize("first_slice,block", [(8, 7), (4096, 1000)])
def test_topk_is_exact(spark, first_slice, block):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 24)).round(2)
    vectors[10:20] = vectors[9]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(300, None), (350, [float("nan")] * 24), (301, [None] + [0.0] * 23), (None, rows[0][1]),
             (302, [float("inf")] + [0.0] * 23), (400, [1.0, 2.0]), (401, [1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn(
        "id", F.lit(1)).withColumn("score", F.lit(2))
    got = topk.top_k(df, df.filter(F.col("vec_id") % 50 == 0), 5, first_slice=first_slice,
                     block=block)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())
    ints = np.floor(256 * vectors).astype(np.int64)
    want = [(400, 1, 401, 256 * 256 - 512 * 512)]
    for q in range(0, 300, 50):
        scores = sorted((-(int(ints[q] @ ints[i])), i) for i in range(300) if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got == sorted(want)


def test_segment_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-256, 256, (50, 64)), rng.integers(-256, 256, (50, 64))
    for segments in topk.LEVELS:
        bound = topk.segment_features(x.astype(float), segments) @ topk.segment_features(
            y.astype(float), segments).T
        assert (bound + 1e-6 >= x @ y.T).all()


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).collect() == []


# --- 3: token counts -----------------------------------------------------------------

def plain_count(word, pieces, byte_scores):
    data = tokens.MARK + word
    best = [(0, 0)]
    for end in range(1, len(data) + 1):
        options = [(best[s][0] + pieces[data[s:end]], best[s][1] - 1)
                   for s in range(end) if data[s:end] in pieces]
        if data[end - 1] not in pieces:
            raw = data[end - 1].encode()
            options.append((best[end - 1][0] + sum(byte_scores[b] for b in raw),
                            best[end - 1][1] - len(raw)))
        best.append(max(options))
    return -best[-1][1], best[-1][0]


def test_token_counts(docs, texts):
    path = P.path("piece_bpe_32k.model")
    pieces, byte_scores = tokens.zipf_scores(path)
    got = tokens.token_counts(docs, path).collect()
    assert len(got) == docs.count()
    for row in got:
        text = texts[row.doc_id] if row.doc_id is not None else None
        if row.doc_id is None or row.doc_id == 13:
            continue
        each = [plain_count(w, pieces, byte_scores) for w in (text or "").split()]
        assert (row.n_words, row.n_tokens, row.score) == (
            len(each), sum(n for n, _ in each), sum(s for _, s in each))


# --- 4: language -----------------------------------------------------------------------

def test_language(spark, empty):
    rng = random.Random(3)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "xyzéè"}
    rows = [(i, words(i, rng.randint(20, 60), alphabets[lang]), lang, "s", 1)
            for i, lang in enumerate(list(alphabets) * 40)]
    rows += [(900, None, "aa", "s", 1), (901, "123 !!", "bb", "s", 1), (902, "abab bcd", None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    train, test = df.filter("doc_id < 60 or doc_id >= 900"), df.filter("doc_id >= 60")
    model = language.fit(train)
    got = {r.doc_id: r for r in language.identify(test, model).collect()}
    assert len(got) == test.count()
    right = [got[r[0]].lang_pred == r[2] for r in rows if 60 <= r[0] < 900]
    assert sum(right) / len(right) > 0.95
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[902].lang_pred in alphabets
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.identify(test, nothing).collect()} == {"und"}
    assert language.identify(empty, model).collect() == []


def test_filter_holds_every_gram(spark):
    df = spark.createDataFrame([(1, words(1, 300), "aa", "s", 1), (2, words(2, 300, "jklmn"), "bb", "s", 1)], DOCS)
    model = language.fit(df)
    for text, lang in ((words(1, 300), "aa"), (words(2, 300, "jklmn"), "bb")):
        grams, _, _ = language.grams_of([text])
        assert model.hits(grams)[:, model.languages.index(lang)].all()


# --- 5: BPE ------------------------------------------------------------------------------

def test_bpe_equals_tiktoken(docs, texts):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_texts(docs, path, P.PATTERN, with_ids=True).collect()
    assert len(got) == docs.count()
    for row in got:
        if row.doc_id is None:
            continue
        text = texts[row.doc_id] or ""
        ids = exact.encode_ordinary(text)
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_prefix_state_appends_and_edits():
    encoder = bpe.PrefixEncoder(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    rng = random.Random(1)
    state = bpe.PrefixState(encoder)
    for _ in range(60):
        state.append("".join(rng.choices("theinglo anü", k=rng.randint(0, 9))).encode())
        a = rng.randint(0, len(state.data))
        b = rng.randint(a, min(len(state.data), a + 5))
        computed = state.replace(a, b, "".join(rng.choices("the in", k=rng.randint(0, 4))).encode())
        assert state.ids() == encoder.path(encoder.extend(state.data, []))
        assert encoder.decode(state.ids()) == state.data
    state = bpe.PrefixState(encoder, b"international relations " * 200)
    computed = state.replace(100, 103, b"XY")
    assert computed < 400 and state.ids() == encoder.path(encoder.extend(state.data, []))


# --- 6: decontamination ---------------------------------------------------------------------

def edit_distance_in(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def test_leaks(spark):
    rng = random.Random(8)
    items = [(i, words(100 + i, 20)) for i in range(5)] + [(5, None), (6, "  "), (7, words(100, 20))]
    rows = []
    for n in range(40):
        body = words(n, 60).split()
        item = list(items[n % 5][1])
        for _ in range(n // 5):
            at = rng.randrange(len(item))
            item[at:at + 1] = rng.choice(["", "x", item[at] + "y"])
        at = rng.randrange(len(body))
        rows.append((n, " ".join(body[:at]) + "\n" + "".join(item).upper() + "  " + " ".join(body[at:])))
    rows += [(50, None), (51, ""), (52, words(52, 500)), (None, items[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(
            df, bench, error_rate=0.08, block_bytes=block).collect()}
        want = {}
        for doc, text in rows:
            for item_id, item in items:
                a, b = decontaminate.normalise(item), decontaminate.normalise(text)
                if a and b and (d := edit_distance_in(a, b)) <= int(len(a) * 0.08):
                    want[doc, item_id] = d
        assert got == want and (None, 0) in got and (0, 7) in got
    kept = {r.doc_id for r in decontaminate.without_leaks(df, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want if d is not None}
    assert decontaminate.leaks(df, bench.limit(0)).collect() == []
    assert decontaminate.leaks(df.limit(0), bench).collect() == []


# --- 7: quality --------------------------------------------------------------------------------

def test_marginals_equal_enumeration():
    scores, stay = np.array([0.3, -1.0, 0.7, 0.2]), np.array([0.8, 0.4])
    total, good = 0.0, np.zeros(4)
    for mask in range(16):
        states = [mask >> i & 1 for i in range(4)]
        weight = np.exp(sum(s for s, x in zip(scores, states) if x) + sum(
            stay[0] if a and b else stay[1] if not (a or b) else 0
            for a, b in zip(states, states[1:])))
        total += weight
        good += weight * np.array(states)
    got, _, _ = quality._Chains(np.array([4])).marginals(scores, stay)
    assert np.allclose(got, good / total)


def test_quality(spark, docs, empty):
    rows = [(i, "\n".join(words(i * 9 + j, 8).capitalize() + "." for j in range(6)) if i % 3 else
             "\n".join(words(i * 9 + j, 8).upper().replace(" ", "!! ") for j in range(6)), "en", "s", 1)
            for i in range(150)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100)] + [(None, 1, 0), (5, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((got[i] >= 0.3) == (i % 3 > 0) for i in range(100, 150))
    assert {r.doc_id for r in quality.keep_good(df, model).collect()} == {i for i in got if got[i] >= 0.3}
    odd = quality.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    untrained = quality.fit(df, labels.limit(0))
    assert {r.score for r in quality.score(df, untrained).collect()} == {0.5}
    assert quality.score(empty, model).collect() == []


# --- 8: chunks ------------------------------------------------------------------------------------

def plain_cuts(data, window):
    gear = chunks.gear_table().tolist()
    hashes, h = [], 0
    for byte in data:
        h = ((h << 1) + gear[byte]) & 0xFFFFFFFF
        hashes.append(h)
    cuts = set()
    for at in range(-window + 1, len(data)):
        inside = range(max(0, at), min(len(data), at + window))
        least = min(hashes[i] for i in inside)
        cuts |= {i for i in inside if hashes[i] == least}
    return sorted(cuts)


def test_cuts_are_the_rolling_ones(texts):
    for text in [t.encode() for t in texts if t and len(t) < 2000]:
        got = np.flatnonzero(chunks.least_in_window(chunks.gear_hashes(np.frombuffer(text, np.uint8)), 16))
        assert got.tolist() == plain_cuts(text, 16)


def test_long_texts_are_cut_alike(monkeypatch, texts):
    data = texts[13].encode()
    whole = chunks._group_cuts([data], 64)[0]
    monkeypatch.setattr(chunks, "SEGMENT", 5000)
    assert chunks._long_cuts(data, 64) == whole
    assert chunks.cuts_of_many([b"x", data, b"", data[:300]], 64)[1] == whole


def test_repeats_are_cut_and_clean_texts_stay(spark):
    shared = [words(1000 + i, 52, "abcdefghijklmnop") for i in range(8)]
    rows = []
    for n in range(60):
        body = words(n, 60, "abcdefghijklmnop")
        if n < 40:
            body = words(n, 37 + n) + "\n" + shared[n % 8] + " " + body
        rows.append((n, body, "en", "s", 1))
    rows += [(70, rows[50][1], "en", "s", 1), (71, None, "en", "s", 1), (72, "", "en", "s", 1),
             (None, rows[50][1], "en", "s", 1), (3, rows[3][1], "en", "s", 1),
             (73, words(5000, 60) + " " + words(5001, 90) + " " + words(5001, 90), "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("x")).withColumn("begin", F.lit(0))
    spans = chunks.repeated_spans(df)
    got = {r.doc_id for r in spans.collect()}
    assert got == set(range(8, 40)) | {70, 73}
    cut = {(r.doc_id, i): r.text for i, r in enumerate(chunks.cut(df, spans).collect())}
    assert len(cut) == len(rows)
    texts = [t for t in cut.values() if t]
    for passage in shared:
        assert sum(passage in t for t in texts) <= 2      # document 3 is there twice
    kept = {k[0]: v for k, v in cut.items()}
    for doc, text, *_ in rows:
        if doc in range(8) or doc in range(40, 60):
            assert kept[doc] == text
    assert chunks.cut(df.limit(0), spans).collect() == []
    assert chunks.repeated_spans(df.limit(0)).collect() == []


# --- 9: urls --------------------------------------------------------------------------------------------

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    cut = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:cut]


def plain_rule(host, path):
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[0]):
                best = (rule, verdict)
    return best


def test_rules(spark):
    some = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/1?x#y", "x://org", "x://org/",
            "x://example.org/en/12", "x://example.org/en/2", "http://b.com/fr/9", "http://b.com/de/9#t",
            "http://borg/x", "a://b://c/d", "http://ÄB.org/é?", "http://h?q/p", "http://h.com#/fr/",
            "http://example.org/es", "x://notexample.org/es/1", "http://n.net/a/b\nc"]
    rows = [(i, u) for i, u in enumerate(some)] + [(None, some[4]), (4, some[4])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x"))
    got = urls.judge(df, RULES).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.page_id is not None:
            host, path = plain_url(some[row.page_id])
            assert (row.host, row.path) == (host, path)
            rule = plain_rule(host, path)
            assert row.rule == (rule[0] if rule else None)
            if rule:
                assert row.verdict == rule[1]
    assert urls.judge(df.limit(0), RULES).collect() == []


def test_templates_follow_their_labels(spark):
    rules = [("block", "h.net/spam/1"), ("allow", "h.net/news/1"), ("block", "g.net/a/bad")]
    rows = [f"http://h.net/{kind}/{n}/x" for kind in ("spam", "news") for n in range(100, 300)]
    rows += [f"http://other.net/{kind}/{n}" for kind in ("spam", "news") for n in range(50)]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {rows[r.page_id]: r for r in urls.judge(df, rules).collect()}
    assert got["http://h.net/spam/250/x"].verdict == "block"
    assert got["http://h.net/spam/250/x"].rule is None
    assert got["http://h.net/news/250/x"].verdict == "allow"
    assert {r.verdict for u, r in got.items() if "other" in u} == {"allow"}


def test_variable_segments_become_wildcards(spark):
    rows = [("h", ["u", f"name{chr(97 + i % 26)}{chr(97 + i // 26)}", "p"], 1, 0, 0) for i in range(60)]
    df = spark.createDataFrame(rows + [("h", ["v"], 50, 0, 0)],
                               "host string, template array<string>, n long, good long, bad long")
    got = {tuple(r.tree) for r in urls.grow(df).collect()}
    assert ("*", "*", "p") in got or ("u", "*", "p") in got
    assert len(got) == 2


# --- 10: WARC ---------------------------------------------------------------------------------------------

def test_warc_round_trip(spark):
    big = "<p>é " + "x" * 1200
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello" + "WARC/1." * 200
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "http://a b\r\nX: y", ""),
             (5, "u", tricky), (6, "u", tricky), (7, "u", "short"), (8, "u", "short"), (9, "u", "z" * 1000),
             (9, "u", "z" * 1000), (-4, "u", big), (None, "u", "q" * 2000), (10, "u", "y" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(df.withColumn("sha1", F.lit("clash")), path)
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, r.payload_digest)
                 for r in warc.captures(spark, path).collect())
    kept = {}
    for page, _, html in pages:
        if html and len(html.encode()) >= 1000:
            kept[html] = max(kept.get(html, -99), page or -98)
    want, seen = [], set()
    for page, _, html in pages:
        data = (html or "").encode()
        first = html not in kept or (page or -98) == kept[html] and html not in seen
        if first and html in kept:
            seen.add(html)
        want.append((page or 0, "response" if first else "revisit", 0 if first else kept[html], len(data),
                     hashlib.sha1(data).hexdigest()))
    assert got == sorted(want)
    rows = warc.assemble(warc.read_records(spark, path, with_payload=True)).collect()
    assert len(rows) == len(pages)
    assert all(r.n_requests == r.n_metadata == 1 and r.request and r.metadata for r in rows)
    payloads = {hashlib.sha1(r.response.payload).hexdigest() for r in rows if r.response.type == "response"}
    assert payloads == {d for _, _, _, _, d in want}
    assert all(r.response.digest == r.response.declared_digest for r in rows)


def test_warc_links_either_way(spark):
    schema = warc.FIELDS
    rows = [("<r1>", "response", "<q1>", None, "u", None, "d", 1, None),
            ("<q1>", "request", None, None, "u", None, "d", 0, None),
            ("<m1>", "metadata", "<r1>", None, "u", None, "d", 0, 5),
            ("<q2>", "request", "<gone>", None, "u", None, "d", 0, None)]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert got["<r1>"].request.record_id == "<q1>" and got["<r1>"].metadata.page_id == 5
    assert got["<gone>"].response is None and got["<gone>"].n_requests == 1


def test_warc_of_nothing(spark):
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.captures(spark, path).collect() == []
