import pytest
from pyspark.sql import functions as F

from docketry.sources import decisions as S
from docketry.sources import vector_store as VS

from .conftest import plan_of

NAMES = "name_en string, document_date_en date, url_en string, unofficial_text_en string"


def write(spark, rows, path, files=1):
    spark.createDataFrame(rows, NAMES).coalesce(files).write.mode("append").parquet(path)


def test_blank_texts_are_dropped_and_order_is_kept(spark, tmp_path):
    path = str(tmp_path / "c")
    texts = ["one", None, "", " \t\n ", "two", " three "]
    write(spark, [(f"n{i}", None, f"u{i}", t) for i, t in enumerate(texts)], path)
    rows = S.read_decisions(spark, path).orderBy("pos").collect()
    assert [(r["pos"], r["url"], r["text"]) for r in rows] == [
        (0, "u0", "one"), (4, "u4", "two"), (5, "u5", " three ")]
    assert rows[0]["document_date"] is None
    assert [r["url"] for r in S.read_decisions(spark, path, max_rows=2).collect()] == ["u0", "u4"]


def test_positions_over_several_files_are_unique_and_ordered(spark, tmp_path):
    path = str(tmp_path / "c")
    for part in range(3):
        write(spark, [(None, None, f"u{part}-{i}", "x") for i in range(5)], path)
    rows = S.read_decisions(spark, path).orderBy("pos").collect()
    assert len({r["pos"] for r in rows}) == 15
    # Rows of a file stay together and in their order.
    urls = [r["url"] for r in rows]
    assert [u.split("-")[1] for u in urls] == list("01234") * 3
    again = S.read_decisions(spark, path).orderBy("pos").collect()
    assert rows == again


def test_missing_columns_are_named(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(1).write.parquet(path)
    with pytest.raises(ValueError, match="url_en.*available columns.*id"):
        S.read_decisions(spark, path)


def test_defaults_of_absent_columns(spark):
    df = spark.createDataFrame([("t",)], "unofficial_text_en string")
    row = S.candidate_projection(df).first()
    assert (row["name"], row["document_date"], row["url"]) == ("Unnamed", "", "")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "pos long, url string, embedding array<float>")


def test_store_segments(spark, tmp_path):
    path = str(tmp_path / "v")
    assert not VS.store_exists(spark, path)
    assert VS.append_vectors(vectors(spark, [(0, "a", [1.0]), (1, "b", [2.0])]), path) == 0
    assert VS.append_vectors(vectors(spark, [(2, "b", [9.0]), (3, "c", [3.0])]), path) == 1
    rows = VS.read_vectors(spark, path).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(0, "a", [1.0]), (1, "b", [2.0]), (3, "c", [3.0])]


def test_unfinished_segments_are_not_read(spark, tmp_path):
    path = str(tmp_path / "v")
    VS.append_vectors(vectors(spark, [(0, "a", [1.0])]), path)
    half = vectors(spark, [(1, "b", [1.0])])
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{path}/segment=1")
    assert VS.read_vectors(spark, path).count() == 1
    assert VS.append_vectors(vectors(spark, [(1, "c", [1.0])]), path) == 2
    assert {r["url"] for r in VS.read_vectors(spark, path).collect()} == {"a", "c"}


def test_rewrite_may_read_its_own_store(spark, tmp_path):
    path = str(tmp_path / "v")
    VS.append_vectors(vectors(spark, [(0, "a", [1.0])]), path)
    VS.append_vectors(vectors(spark, [(1, "a", [1.0]), (2, "b", [1.0])]), path)
    VS.write_vectors(VS.read_vectors(spark, path), path)
    assert [s.number for s in VS.manifest_of(spark, path).segments] == [2]
    assert VS.read_vectors(spark, path).count() == 2
    VS.vacuum(spark, path, keep=1)
    assert [p.name for p in (tmp_path / "v").glob("segment=*")] == ["segment=2"]
    assert VS.read_vectors(spark, path).count() == 2


def test_reading_a_store_compares_no_keys(spark, tmp_path):
    path = str(tmp_path / "v")
    for part in range(3):
        VS.append_vectors(vectors(spark, [(part * 10 + i, f"u{part}{i}", [1.0]) for i in range(9)]),
                          path)
    plan = plan_of(VS.read_vectors(spark, path))
    assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan
    assert VS.read_vectors(spark, path).count() == 27


@pytest.mark.parametrize("filters", [True, False])
def test_only_keys_that_may_be_known_are_compared(spark, tmp_path, filters, monkeypatch):
    """Repeats inside a segment, across segments, ties, null urls, lower positions later."""
    if not filters:
        monkeypatch.setattr(VS, "_FILTERS_BYTES", 0)
    parts = [[(0, "a", [1.0]), (1, "b", [2.0]), (2, "b", [3.0]), (3, None, [4.0])],
             [(10, "x", [5.0]), (11, "z", [6.0])],
             [(20, "a", [7.0]), (21, "c", [8.0]), (22, None, [9.0]), (-1, "z", [10.0])],
             [(30, "c", [11.0]), (21, "c", [12.0]), (31, "d", [13.0])]]
    path, everything = str(tmp_path / "v"), []
    for rows in parts:
        VS.append_vectors(vectors(spark, rows), path)
        everything += rows
        best = {}
        for pos, url, vec in everything:
            if url not in best or pos < best[url][0]:
                best[url] = (pos, vec)
        got = {r["url"]: (r["pos"], r["embedding"]) for r in VS.read_vectors(spark, path).collect()}
        assert got == best
    # Equal url and position inside one segment.
    VS.append_vectors(vectors(spark, [(40, "t", [1.0]), (40, "t", [1.0])]), path)
    assert VS.manifest_of(spark, path).tied
    assert VS.read_vectors(spark, path).filter("url = 't'").count() == 1
    report = VS.compact(spark, path)
    assert report.total == len(best) + 1 and report.segments == 1
    assert VS.manifest_of(spark, path).repeats is None
    assert "Exchange" not in plan_of(VS.read_vectors(spark, path))
    assert VS.read_vectors(spark, path).count() == len(best) + 1


def test_a_filter_passes_every_known_key(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.range(3000).select(F.col("id").alias("pos"), F.concat(F.lit("u"), "id").alias("url"),
                                    F.array(F.lit(1.0).cast("float")).alias("embedding"))
    VS.append_vectors(rows, path)
    (segment,) = VS.manifest_of(spark, path).segments
    filters = [(VS._bits_for(segment.rows), VS._read_filter(spark, path, segment))]
    assert VS._maybe_known(rows.select("url"), filters).count() == 3000
    others = rows.select(F.concat(F.lit("v"), "pos").alias("url"))
    assert VS._maybe_known(others, filters).count() < 150


def test_merging_reports_and_swaps_in_one_step(spark, tmp_path):
    path = str(tmp_path / "v")
    VS.append_vectors(vectors(spark, [(0, "a", [1.0]), (1, "b", [2.0])]), path)
    during = VS.read_vectors(spark, path)
    report = VS.merge_vectors(spark, path, vectors(spark, [(5, "b", [9.0]), (6, "c", [3.0])]),
                              vectors(spark, [(7, "c", [4.0]), (8, "d", [5.0]), (9, "d", [6.0])]))
    assert report == (4, 2, 3)
    assert sorted(r["url"] for r in during.collect()) == ["a", "b"]
    during = VS.read_vectors(spark, path)
    assert VS.compact(spark, path, partitions=2) == (4, 0, 1)
    # A reader that began before the swap still sees its state, one after it the new one.
    expected = [(0, "a"), (1, "b"), (6, "c"), (8, "d")]
    for reader in (during, VS.read_vectors(spark, path)):
        assert sorted((r["pos"], r["url"]) for r in reader.collect()) == expected
    assert VS.compact(spark, path) == (4, 0, 1)
    VS.vacuum(spark, path, keep=1)
    assert len(list((tmp_path / "v").glob("segment=*"))) == 1


def test_two_changes_at_once_do_not_both_count(spark, tmp_path):
    path = str(tmp_path / "v")
    VS.append_vectors(vectors(spark, [(0, "a", [1.0])]), path)
    state = VS.manifest_of(spark, path)
    VS.append_vectors(vectors(spark, [(1, "b", [1.0])]), path)
    with pytest.raises(RuntimeError, match="changed by another run"):
        VS._commit(spark, path, state)


def test_a_store_without_a_manifest_is_read_and_taken_over(spark, tmp_path):
    path = str(tmp_path / "v")
    vectors(spark, [(0, "a", [1.0]), (1, "b", [2.0])]).write.parquet(f"{path}/segment=0")
    vectors(spark, [(2, "b", [1.0])]).write.parquet(f"{path}/segment=1")
    assert VS.store_exists(spark, path) and VS.read_vectors(spark, path).count() == 2
    VS.append_vectors(vectors(spark, [(3, "a", [1.0]), (4, "e", [1.0])]), path)
    assert [s.rows for s in VS.manifest_of(spark, path).segments] == [2, 1, 2]
    assert sorted(r["pos"] for r in VS.read_vectors(spark, path).collect()) == [0, 1, 4]


def test_inconsistent_stores_are_rejected(spark, tmp_path):
    for i, rows in enumerate([[(0, "a", [1.0]), (1, "b", [1.0, 2.0])], [(0, "a", None)]]):
        path = str(tmp_path / f"v{i}")
        VS.append_vectors(vectors(spark, rows), path)
        with pytest.raises(ValueError, match="inconsistent"):
            VS.read_vectors(spark, path)


def test_chunks_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "k")
    assert VS.read_chunks(spark, path) is None
    rows = vectors(spark, [(i, f"u{i}", [1.0]) for i in range(4)])
    VS.write_chunks(rows.withColumn("chunk_id", (F.col("pos") / 2).cast("long")), path)
    VS.write_chunks(vectors(spark, [(9, "u9", [1.0])]).withColumn("chunk_id", F.lit(1)), path)
    assert {r["url"] for r in VS.read_chunks(spark, path).collect()} == {"u0", "u1", "u9"}
    assert len(VS.read_chunks(spark, path).columns) == 4


def test_texts_of_many_files_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = [(f"n{i}", "2020", f"u{i}", f"text {i}") for i in range(40)]
    spark.createDataFrame(rows, "name_en string, document_date_en string, url_en string,"
                          " unofficial_text_en string").repartition(4).write.parquet(path)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        df = S.read_decisions(spark, path)
        assert df.select("pos").distinct().count() == 40
        assert "hashpartitioning" not in plan_of(df) and "SortMergeJoin" not in plan_of(df)
    finally:
        spark.conf.set(limit, before)


def test_a_cluster_needs_a_shared_folder():
    from docketry.session import is_local

    assert is_local("local") and is_local("local[4]")
    assert not is_local("local-cluster[2,1,1024]") and not is_local("yarn")
