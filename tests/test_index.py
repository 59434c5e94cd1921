import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import batching, dedupe, joins, models, positions
from docketry.plans import index
from docketry.plans.index import build_index, delta_index
from docketry.sources import chunk_store
from docketry.sources.vector_store import append_vectors, read_vectors
from docketry.streaming.delta import index_stream, rejected_files

from .conftest import plan_of

DECISIONS = "pos long, url string, name string, document_date string, text string"


def corpus(spark, n, start=0, words=3):
    rng = random.Random(n + start)
    rows = [(start + i, f"u{start + i}", "n", "2020", "word " * rng.randint(1, words))
            for i in range(n)]
    return spark.createDataFrame(rows, DECISIONS)


def store_of(spark, urls):
    rows = [(i, u, [1.0] * 4) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "pos long, url string, embedding array<float>")


def urls(spark, path):
    return sorted(r["url"] for r in read_vectors(spark, path).collect())


@pytest.mark.parametrize("threshold,route", [(1000, "single"), (1, "chunked")])
def test_delta_adds_what_is_missing_once(spark, tmp_path, threshold, route):
    path, df = str(tmp_path / "v"), corpus(spark, 30)
    append_vectors(store_of(spark, [f"u{i}" for i in range(10)]), path)
    encoder = models.hashed_terms(4)
    report = delta_index(df, path, encoder, threshold=threshold, chunk_size=8)
    assert report == (route, 10, 20, 30, 0)
    assert urls(spark, path) == sorted(f"u{i}" for i in range(30))
    rows = read_vectors(spark, path).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(30))
    assert delta_index(df, path, encoder, threshold=threshold) == ("none", 30, 0, 30, 0)
    # Positions of new rows follow text length.
    lengths = {r["url"]: len(r["text"]) for r in df.collect()}
    added = [lengths[r["url"]] for r in rows[10:]]
    assert added == sorted(added)


def test_delta_starts_a_store(spark, tmp_path):
    path = str(tmp_path / "v")
    assert delta_index(corpus(spark, 5), path, models.hashed_terms(4)) == ("single", 0, 5, 5, 0)


def test_duplicates_in_the_corpus_are_encoded_once(spark, tmp_path):
    path, calls = str(tmp_path / "v"), spark.sparkContext.accumulator(0)
    df = corpus(spark, 6).withColumn("url", F.when(F.col("pos") < 4, "same").otherwise(
        F.col("url")))
    inner = models.hashed_terms(4)

    def encoder(texts):
        calls.add(len(texts))
        return inner(texts)

    assert delta_index(df, path, encoder).added == 3
    assert calls.value == 3


@pytest.mark.parametrize("threshold", [1000, 1])
def test_a_null_url_is_new_but_kept_once(spark, tmp_path, threshold):
    path = str(tmp_path / "v")
    df = corpus(spark, 4).withColumn("url", F.when(F.col("pos") > 1, F.col("url")))
    assert joins.new_decisions(df, store_of(spark, ["u2", "u3"])).count() == 2
    assert delta_index(df, path, models.hashed_terms(4), threshold=threshold).total == 3
    assert delta_index(df, path, models.hashed_terms(4), threshold=threshold).total == 3


def own(texts):
    """Texts of the corpus, not those an encoder is known by."""
    return [t for t in texts if t.startswith("word ")]


def stops(encoder, text, seen=None):
    """An encoder that fails at a text."""
    def run(texts):
        if seen is not None:
            seen.add(len(own(texts)))
        if text in texts:
            raise RuntimeError("broken off")
        return encoder(texts)

    return run


def long_corpus(spark, n):
    """Texts of unlike lengths, the longest last."""
    return spark.createDataFrame(
        [(i, f"u{i}", "n", "2020", "word " * (i + 1)) for i in range(n)], DECISIONS)


def broken_off(spark, df, path, work, encoder, chunk_size=8, **options):
    """A run that ends with an error at its longest text, late in its last task."""
    with pytest.raises(Exception, match="broken off"):
        delta_index(df, path, stops(encoder, "word " * df.count()), work_path=work, threshold=1,
                    chunk_size=chunk_size, **options)
    (run,) = [p for p in __import__("pathlib").Path(work).iterdir()]
    return str(run)


def test_interrupted_run_resumes(spark, tmp_path):
    path, work = str(tmp_path / "v"), str(tmp_path / "w")
    df, seen = long_corpus(spark, 160), spark.sparkContext.accumulator(0)
    run = broken_off(spark, df, path, work, models.hashed_terms(4))
    done = chunk_store.read_chunks(spark, run).count()
    assert 0 < done < 160
    ranges = chunk_store.finished_ranges(spark, run).collect()
    assert sum(r["rows"] for r in ranges) == done and all(r["chunks"] == 1 for r in ranges)
    inner = models.hashed_terms(4)

    def encoder(texts):
        seen.add(len(own(texts)))
        return inner(texts)

    report = delta_index(df, path, encoder, work_path=work, threshold=1, chunk_size=8)
    assert report.total == 160 and seen.value == 160 - done
    assert urls(spark, path) == sorted(f"u{i}" for i in range(160))
    assert not __import__("os").path.isdir(work)


@pytest.mark.parametrize("change", ["encoder", "limit", "store", "name"])
def test_another_run_takes_up_nothing(spark, tmp_path, change):
    """Encoders of one factory, another limit, another state of the store, another name."""
    path, work = str(tmp_path / "v"), str(tmp_path / "w")
    df = long_corpus(spark, 80)
    names = {"encoder_name": "one"} if change == "name" else {}
    broken_off(spark, df, path, work, models.hashed_terms(4), **names)
    encoder, options = models.hashed_terms(4), {}
    if change == "encoder":
        encoder = models.hashed_terms(6)
    elif change == "limit":
        options = {"max_chars": 12}
    elif change == "name":
        options = {"encoder_name": "two"}
    else:
        append_vectors(store_of(spark, ["other"]), path)
    seen = spark.sparkContext.accumulator(0)
    report = delta_index(df, path, stops(encoder, None, seen), work_path=work, threshold=1,
                         chunk_size=8, **options)
    assert report.added == 80 and seen.value == 80
    fresh = str(tmp_path / "fresh")
    if change == "store":
        append_vectors(store_of(spark, ["other"]), fresh)
    options.pop("encoder_name", None)
    delta_index(df, fresh, encoder, **options)
    assert sorted(map(str, read_vectors(spark, path).collect())) == sorted(
        map(str, read_vectors(spark, fresh).collect()))


def test_encoders_are_told_apart(spark):
    same = [models.encoder_fingerprint(spark, models.hashed_terms(8)) for _ in range(2)]
    assert same[0] == same[1]
    others = [models.hashed_terms(4), lambda texts: np.ones((len(texts), 8)),
              lambda texts: np.array([[len(t)] for t in texts])]
    prints = {models.encoder_fingerprint(spark, e) for e in others} | {same[0]}
    assert len(prints) == 4
    cut = models.encoder_fingerprint(spark, models.hashed_terms(8), max_chars=100)
    assert cut != same[0]
    assert models.encoder_fingerprint(spark, others[1], "v2") == "name v2"


def test_many_chunks_are_few_files(spark, tmp_path):
    """A file a task, however many chunks it takes; nothing is listed by chunk."""
    work = str(tmp_path / "w")
    rows = spark.range(100_000).select(
        F.col("id").alias("pos"), F.concat(F.lit("u"), "id").alias("url"),
        F.array(F.lit(1.0).cast("float")).alias("embedding"), F.col("id").alias("chunk_id"))
    tasks = batching.chunk_partitions(100_000, 1, most=6)
    chunk_store.write_chunks(
        rows.repartitionById(tasks, F.pmod("chunk_id", F.lit(tasks)).cast("int")), work)
    files = [p for p in (tmp_path / "w").rglob("*.parquet")]
    assert len(files) == 6 and chunk_store.finished_ranges(spark, work).agg(
        F.sum("chunks"), F.count("file")).first()[:] == (100_000, 6)
    assert chunk_store.read_chunks(spark, work).count() == 100_000


def test_tasks_of_a_run_follow_the_text(spark, tmp_path, monkeypatch):
    """A run of many small chunks is few tasks, more only for more text."""
    cores = spark.sparkContext.defaultParallelism
    assert index.run_tasks(spark, 0) == index.RUN_TASKS_PER_CORE * cores
    assert index.run_tasks(spark, 1 << 50) == (1 << 50) // index.TASK_CHARS + 1
    seen, planned = [], index.encode_planned
    monkeypatch.setattr(index, "RUN_TASKS_PER_CORE", 1)
    monkeypatch.setattr(index, "encode_planned", lambda *a, **k: seen.append(a[4]) or planned(*a, **k))
    path, df = str(tmp_path / "v"), corpus(spark, 40)
    report = delta_index(df, path, models.hashed_terms(4), threshold=1, chunk_size=1)
    assert report == ("chunked", 0, 40, 40, 0) and urls(spark, path) == sorted(
        f"u{i}" for i in range(40))
    assert seen == [cores] and cores < 40


def test_workers_get_few_texts_at_once(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(64 << 20))
    models.encode(spark.createDataFrame([("one",)], "text string"), models.hashed_terms(4))
    assert int(spark.conf.get(key)) <= models.TEXT_BYTES


def test_keys_are_found_without_reading_texts(spark, tmp_path):
    path = str(tmp_path / "c")
    corpus(spark, 20).write.parquet(path)
    keys = dedupe.dedupe_keep_first(spark.read.parquet(path).select("pos", "url"), "url")
    plan = plan_of(joins.new_decisions(keys, store_of(spark, ["u1"])))
    assert "ReadSchema: struct<pos:bigint,url:string>" in plan


@pytest.mark.parametrize("limit", [10**6, -1])
def test_plan_of_a_delta(spark, monkeypatch, limit):
    """The same whether the new documents are kept or read again."""
    monkeypatch.setattr(index, "BROADCAST_BYTES", limit)
    df = corpus(spark, 20)
    documents = index.new_documents(df, index.new_keys(df, store_of(spark, ["u1"])))
    planned = index.plan_delta(documents, chunk_size=6)
    assert "text" not in planned.columns
    rows = planned.orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(19))
    assert [r["chunk_id"] for r in rows] == [i // 6 for i in range(19)]


def test_lengths_of_a_large_delta_move_no_text(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    corpus(spark, 20).write.parquet(path)
    df = spark.read.parquet(path)
    keys = index.new_keys(df, store_of(spark, ["u1"]))
    monkeypatch.setattr(index, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(index, "broadcast_within", lambda df, **_: df.hint("merge"))
    documents = index.new_documents(df, keys)
    plan = plan_of(documents.select("pos", "url", "length"))
    physical = plan[plan.index("== Physical Plan =="):]
    # What the scan gives the join is the length; text is used in its projection only.
    assert "SortMergeJoin" in physical
    above = physical[:physical.index("length(text")]
    assert "text#" not in above


def test_merging_moves_no_vectors(spark, tmp_path):
    path = str(tmp_path / "s")
    append_vectors(store_of(spark, ["a", "b"]), path)
    store = read_vectors(spark, path)
    merged = dedupe.merge_store(store, store_of(spark, ["b", "c"]).withColumn(
        "pos", F.col("pos") + 10))
    plan = plan_of(merged)
    assert "Window" not in plan and "hashpartitioning" not in plan
    assert sorted((r["pos"], r["url"]) for r in merged.collect()) == [
        (0, "a"), (1, "b"), (11, "c")]


def test_route_of_a_column(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 999, 1000)], "n long")
    assert [r[0] for r in rows.select(batching.route_column(F.col("n"))).collect()] == [
        "none", "single", "single", "chunked"]


def test_routes():
    assert [batching.plan_route(n) for n in (0, 1, 999, 1000)] == [
        "none", "single", "single", "chunked"]
    assert [batching.chunk_partitions(n) for n in (0, 500, 501, 10**9)] == [1, 1, 2, 20_000]


def test_dense_index_over_a_hot_value(spark):
    """A third of all rows share a length; numbers stay dense and in order."""
    df = spark.range(3000).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, 7).otherwise(
            F.col("id") % 50).alias("length"))
    out = positions.with_dense_index(df, ["length", "pos"], partitions=7).orderBy("idx").collect()
    assert [r["idx"] for r in out] == list(range(3000))
    keys = [(r["length"], r["pos"]) for r in out]
    assert keys == sorted(keys)


def limits(batch):
    return len(batch) == 1 or (len(batch) <= 64 and sum(batch) <= 65536)


def test_batches_respect_limits_and_equal_the_task_helper(spark):
    rng = random.Random(4)
    chunks = {c: sorted(rng.choice([5, 900, 3000, 40_000, 300_000]) + rng.randint(0, 400)
                        for _ in range(rng.randint(1, 300))) for c in range(6)}
    chunks[6] = [4 * 1024] * 64 + [4 * 1024] * 2
    rows = [(c, i, n, max(1, (n + 3) // 4)) for c, ns in chunks.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "chunk_id long, idx long, length int, tokens long")
    got = {}
    for r in batching.assign_batches(df).orderBy("chunk_id", "idx").collect():
        got.setdefault(r["chunk_id"], []).append((r["batch_id"], r["tokens"]))
    for c, lengths in chunks.items():
        batches = {}
        for b, tokens in got[c]:
            batches.setdefault(b, []).append(tokens)
        assert sorted(batches) == list(range(len(batches)))
        assert all(limits(b) for b in batches.values())
        ordered = [batches[b] for b in sorted(batches)]
        # No batch could have taken the next row as well.
        assert not any(limits(a + b[:1]) for a, b in zip(ordered, ordered[1:]))
        spans = list(batching.greedy_batches(lengths))
        assert [len(b) for b in ordered] == [stop - start for start, stop in spans]


def test_dedupe_and_counts(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, None), (4, None)],
                               "pos long, url string")
    assert sorted(r["pos"] for r in dedupe.dedupe_keep_first(df, "url").collect()) == [1, 2, 4]
    assert tuple(dedupe.duplicate_counts(df, "url").first()) == (5, 3, 2)
    assert tuple(dedupe.duplicate_counts(df.filter("false"), "url").first()) == (0, 0, 0)


def test_drop_repeats_equals_keep_first(spark, tmp_path):
    """No repeats, a hot key, null keys, ties, and too many repeats to broadcast."""
    cases = {
        "none": [(i, f"u{i}") for i in range(20)],
        "hot": [(i, "hot" if i % 3 == 0 else f"u{i}") for i in range(60)],
        "null": [(i, None if i % 2 else f"u{i}") for i in range(20)],
        "tied": [(1, "a"), (1, "a"), (2, "a"), (3, "b")],
    }
    for rows in cases.values():
        df = spark.createDataFrame(rows, "pos long, url string")
        expected = sorted(map(str, dedupe.dedupe_keep_first(df, "url").collect()))
        for max_bytes in (10**6, 0):
            out = dedupe.drop_repeats(df, "url", max_bytes=max_bytes)
            assert sorted(map(str, out.collect())) == expected
    wide = spark.createDataFrame(cases["hot"], "pos long, url string")
    assert "Window" not in plan_of(dedupe.drop_repeats(wide, "url"))


def test_align(spark, tmp_path):
    df, store = corpus(spark, 4), store_of(spark, ["u3", "u1", "x"])
    rows = joins.align(df, store).orderBy("pos").collect()
    assert [(r["pos"], r["url"]) for r in rows] == [(1, "u1"), (3, "u3")]
    assert rows[0]["embedding"] == [0.5] * 4
    assert joins.missing_vectors(df, store).count() == 2
    assert joins.with_vectors(df, store).count() == 2
    with pytest.raises(ValueError, match="do not match"):
        joins.align(df, store_of(spark, ["x"]))
    with pytest.raises(ValueError, match="no vectors"):
        joins.align(df, store_of(spark, ["x"]).filter("false"))
    with pytest.raises(ValueError, match="no decisions"):
        joins.align(df.filter("false"), store)
    built = build_index(df, store, str(tmp_path / "i"))
    assert built.count() == 2


def test_encoder_contract(spark):
    df = corpus(spark, 3)

    def bad_row(texts):
        out = np.ones((len(texts), 2))
        out[0, 1] = np.inf
        return out

    rows = models.encode(df.coalesce(1), bad_row, keep=["url"]).collect()
    assert sorted(r["embedding"] for r in rows) == [[0.0, 0.0], [1.0, 1.0], [1.0, 1.0]]
    with pytest.raises(Exception, match="vectors for"):
        models.encode(df, lambda texts: np.ones((len(texts) + 1, 2)), keep=["url"]).collect()


def batch_calls(df, keep, **options):
    """What each model call got, as the number of texts and their total length."""
    def encoder(texts):
        return np.array([[len(texts), sum(map(len, texts))]] * len(texts))

    return models.encode(df, encoder, keep=keep, **options)


def test_model_batches_cross_arrow_batches_and_equal_assign_batches(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([3, 40, 3000, 90_000])) for i in range(400)]
    df = spark.createDataFrame(rows, "pos long, length int").withColumn(
        "url", F.col("pos").cast("string"))
    planned = batching.assign_chunks(df, 150).withColumn(
        "tokens", F.greatest(F.lit(1), F.ceil(F.col("length") / 4)))
    expected = {r["idx"]: (r["n"], r["total"]) for r in batching.assign_batches(planned).join(
        planned.select("idx", "length"), "idx").select(
        "idx", F.expr("count(1) over (partition by chunk_id, batch_id)").alias("n"),
        F.expr("sum(length) over (partition by chunk_id, batch_id)").alias("total")).collect()}
    texts = planned.withColumn("text", F.expr("repeat('x', length)"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for records in ("7", "10000"):
        spark.conf.set(key, records)
        ordered = texts.repartitionById(2, F.pmod("chunk_id", F.lit(2)).cast("int")
                                        ).sortWithinPartitions("idx")
        got = batch_calls(ordered, ["idx", "chunk_id"], group="chunk_id").collect()
        assert {r["idx"]: tuple(r["embedding"]) for r in got} == expected
    spark.conf.set(key, before)


def test_memory_of_a_task_follows_a_batch_not_the_table():
    """400 texts of 1 MB pass through; a few are held."""
    import tracemalloc

    import pyarrow as pa

    def arriving():
        for i in range(400):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i]), pa.array(["x" * 1_000_000])], names=["i", "_text"])

    tracemalloc.start()
    held = pa.total_allocated_bytes()
    most, seen = 0, 0
    for rows, texts, _ in models.model_batches(arriving(), 1):
        assert rows.num_rows == len(texts) == 1
        seen += len(texts)
        most = max(most, pa.total_allocated_bytes() - held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 400 and peak < 10_000_000 and most < 10_000_000


WORDS = models.TokenCounter(lambda text: [m.end() for m in __import__("re").finditer(r"\S+", text)])


def test_token_limits(spark, tmp_path):
    df = long_corpus(spark, 20)
    got = {r["url"]: (r["embedding"][0], r["_cut"]) for r in models.encode(
        df, lambda texts: np.array([[len(t.split())] for t in texts]), keep=["url"],
        max_tokens=5, counter=WORDS, cut="_cut").collect()}
    assert got == {f"u{i}": (min(i + 1, 5), i >= 5) for i in range(20)}
    assert WORDS.cut("", 3) == ("", False) and WORDS.cut("a b", 0) == ("", True)
    # Without a counter the limit is the encoder's own.
    def limited(texts, max_tokens):
        return np.full((len(texts), 1), max_tokens)

    rows = models.encode(df, limited, keep=["url"], max_tokens=7, cut="_cut").collect()
    assert {(r["embedding"][0], r["_cut"]) for r in rows} == {(7.0, False)}
    for threshold in (1000, 1):
        report = delta_index(df, str(tmp_path / f"v{threshold}"), models.hashed_terms(4),
                             threshold=threshold, max_tokens=5, counter=WORDS)
        assert report.cut == 15 and report.added == 20


def test_truncation_ahead_of_encoding(spark):
    df = corpus(spark, 3, words=50)
    seen = models.encode(df, lambda texts: np.array([[len(t)] for t in texts]), max_chars=7,
                         keep=["url"]).collect()
    assert max(r["embedding"][0] for r in seen) <= 7


def test_stream_adds_new_files_and_survives_a_replay(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "v")
    encoder = models.hashed_terms(4)

    def run(checkpoint):
        index_stream(spark, source, path, encoder, str(tmp_path / checkpoint),
                     files_per_batch=1).awaitTermination()
        return urls(spark, path)

    def arrive(n, start=0):
        rows = corpus(spark, n, start=start)
        rows.select(F.col("name").alias("name_en"), F.col("document_date").alias("document_date_en"),
                    F.col("url").alias("url_en"), F.col("text").alias("unofficial_text_en")
                    ).coalesce(1).write.mode("append").parquet(source)

    arrive(10)
    assert len(run("c1")) == 10
    arrive(15, 5)
    assert len(run("c1")) == 20
    # A lost stream checkpoint replays every file; nothing is added twice.
    assert len(run("c2")) == 20
    assert sorted(r["pos"] for r in read_vectors(spark, path).collect()) == list(range(20))


def test_files_that_each_count_from_zero_lose_nothing(spark, tmp_path):
    one = corpus(spark, 20)
    two = corpus(spark, 20, start=100).withColumn("pos", F.col("pos") - F.lit(100))
    calls = spark.sparkContext.accumulator(0)
    inner = models.hashed_terms(4)

    def encoder(texts):
        calls.add(len(own(texts)))
        return inner(texts)

    for threshold in (1000, 1):
        path = str(tmp_path / f"v{threshold}")
        before = calls.value
        assert delta_index(one.unionByName(two).unionByName(two.limit(3)), path, encoder,
                           threshold=threshold).added == 40
        rows = read_vectors(spark, path, check=False).collect()
        assert len({r["url"] for r in rows}) == len({r["pos"] for r in rows}) == len(rows) == 40
        assert calls.value - before == 40


def test_chunks_of_another_run_are_not_reused(spark, tmp_path):
    import os

    path = str(tmp_path / "v")
    delta_index(corpus(spark, 12), path, models.hashed_terms(4), threshold=1)
    chunks = f"{path}/_chunks"
    assert not os.path.isdir(chunks) or not os.listdir(chunks)


def test_a_null_url_is_encoded_once(spark, tmp_path):
    path = str(tmp_path / "v")
    df = corpus(spark, 3).withColumn("url", F.when(F.col("pos") > 0, F.col("url")))
    assert delta_index(df, path, models.hashed_terms(4)).added == 3
    assert delta_index(df, path, models.hashed_terms(4)) == ("none", 3, 0, 3, 0)


def test_files_of_another_layout_are_set_aside(spark, tmp_path):
    """Missing columns, other types, no Parquet at all, rows of nulls: the rest is indexed."""
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "v", "c"))
    rows = corpus(spark, 6).select(
        F.col("name").alias("name_en"), F.col("document_date").alias("document_date_en"),
        F.col("url").alias("url_en"), F.col("text").alias("unofficial_text_en"))

    def arrive(df):
        df.coalesce(1).write.mode("append").parquet(source)

    arrive(rows)
    arrive(rows.limit(2).select(*[F.lit(None).cast("string").alias(c) for c in rows.columns]))
    arrive(corpus(spark, 4))
    arrive(rows.limit(1).withColumn("unofficial_text_en", F.lit(5)))
    arrive(rows.limit(1).withColumn("url_en", F.array("url_en")))
    arrive(rows.limit(1).withColumns({"url_en": F.lit("dated"), "document_date_en": F.current_date()}))
    (tmp_path / "in" / "broken.parquet").write_bytes(b"no parquet")
    index_stream(spark, source, path, models.hashed_terms(4), checkpoint,
                 files_per_batch=3).awaitTermination()
    assert urls(spark, path) == sorted(["dated", *(f"u{i}" for i in range(6))])
    found = {r["reason"].split(":")[0]: r for r in rejected_files(spark, checkpoint).collect()}
    assert rejected_files(spark, checkpoint).count() == 4
    assert set(found) == {"missing columns", "columns of another type", "unreadable"}
    assert found["missing columns"]["missing"] == [
        "name_en", "document_date_en", "url_en", "unofficial_text_en"]
    assert "text" in found["missing columns"]["available"]
    assert rejected_files(spark, str(tmp_path / "other")).count() == 0


def test_a_stream_restarted_with_another_encoder_mixes_nothing(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "v", "c"))
    df = long_corpus(spark, 80)
    df.select(F.col("name").alias("name_en"), F.col("document_date").alias("document_date_en"),
              F.col("url").alias("url_en"), F.col("text").alias("unofficial_text_en")
              ).coalesce(1).write.parquet(source)
    options = {"threshold": 1, "chunk_size": 8}
    with pytest.raises(Exception, match="broken off"):
        index_stream(spark, source, path, stops(models.hashed_terms(4), "word " * 80), checkpoint,
                     **options).awaitTermination()
    index_stream(spark, source, path, models.hashed_terms(6), checkpoint,
                 **options).awaitTermination()
    assert {len(r["embedding"]) for r in read_vectors(spark, path).collect()} == {6}
    assert len(urls(spark, path)) == 80


def test_cut_texts_are_reported(spark, tmp_path):
    df = corpus(spark, 3, words=50)
    assert delta_index(df, str(tmp_path / "v"), models.hashed_terms(4), max_chars=7).cut == 3
