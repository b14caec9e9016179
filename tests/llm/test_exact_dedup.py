import pytest

from llm import exact_dedup as E

SCHEMA = "doc_id long, text string"


def test_batches_against_the_index(spark):
    index = E.DigestIndex.temporary(spark, buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "")], SCHEMA).selectExpr("*", "9 AS digest", "8 AS keep_id")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in E.ingest(index, first).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True)}
    then = spark.createDataFrame([(6, "a"), (7, "c"), (2, "a"), (None, "d")], SCHEMA)
    got = {r.doc_id: (r.keep_id, r.kept) for r in E.ingest(index, then).collect()}
    assert got == {6: (2, False), 7: (7, True), 2: (2, False), None: (None, True)}
    assert index.read().count() == 5


def test_empty_table_and_repeated_rows(spark):
    index = E.DigestIndex.temporary(spark, buckets=2)
    assert E.ingest(index, spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, "x" * 100_000)] * 3, SCHEMA)
    assert {(r.keep_id, r.group_size, r.kept) for r in E.ingest(index, rows).collect()} == {(1, 3, True)}


def test_one_whole_row_of_each_text_stays(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "z")], SCHEMA).selectExpr("*", "doc_id AS other")
    index = E.DigestIndex.temporary(spark, buckets=2)
    assert sorted((r.doc_id or 0, r.text, r.other) for r in E.deduplicated(index, rows).collect()) == [(0, "z", None), (2, "a", 2), (4, "", 4)]
    assert E.deduplicated(index, rows, batch="later").count() == 0


def ids(rows):
    return sorted(r.doc_id for r in rows.collect() if r.kept)


def test_an_index_is_opened_by_its_path_in_a_new_session(spark, tmp_path):
    first, path = E.DigestIndex(spark, "digests_one", f"{tmp_path}/index", 4), f"{tmp_path}/index"
    assert not first.exists()
    assert ids(E.ingest(first, spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA))) == [1, 2]
    spark.sql("DROP TABLE digests_one")  # a new session's catalog knows nothing; the files stay
    other = E.DigestIndex(spark.newSession(), "digests_one", path, 4)
    assert other.exists()
    assert ids(E.ingest(other, spark.createDataFrame([(3, "a"), (4, "c")], SCHEMA))) == [4]
    assert other.read().count() == 3
    with pytest.raises(ValueError, match="4 buckets"):
        E.DigestIndex(spark, "digests_two", path, 8).read()
    elsewhere = E.DigestIndex(spark, "digests_one", f"{tmp_path}/elsewhere", 4)
    with pytest.raises(ValueError, match="not below"):
        elsewhere.read()
    assert other.read().count() == 3


def test_the_same_batch_again_gives_the_same_rows(spark, tmp_path):
    index = E.DigestIndex(spark, "digests_again", f"{tmp_path}/index", 4)
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, None)], SCHEMA)
    once = sorted(map(str, E.ingest(index, rows).collect()))
    assert sorted(map(str, E.ingest(index, rows.repartition(3)).collect())) == once
    assert sorted(map(str, E.ingest(index, rows, batch="other").collect())) != once
    kept = sorted(map(str, E.deduplicated(index, rows.selectExpr("doc_id", "concat(text, '!') AS text")).collect()))
    assert sorted(map(str, E.deduplicated(index, rows.selectExpr("doc_id", "concat(text, '!') AS text")).collect())) == kept and len(kept) == 2
    assert index.read().count() == index.read().select("digest").distinct().count() == 5


def test_a_batch_cut_off_within_its_append_is_finished(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 20}") for i in range(50)], SCHEMA)
    whole = E.DigestIndex(spark, "digests_whole", f"{tmp_path}/whole", 4)
    wanted = sorted(map(str, E.ingest(whole, rows, batch="b").collect()))
    index = E.DigestIndex(spark, "digests_cut", f"{tmp_path}/index", 4)
    groups = E.groups_of(E.digests(rows))
    index.append(groups.where("keep_id % 3 = 0"), "b")  # what a lost driver left
    assert sorted(map(str, E.ingest(index, rows, batch="b").collect())) == wanted
    assert index.read().count() == 20


def test_compaction_keeps_all_rows_in_one_file_per_bucket(spark, tmp_path):
    index = E.DigestIndex(spark, "digests_small", f"{tmp_path}/index", 2)
    index.compact()
    assert not index.exists()
    for k in range(3):
        E.ingest(index, spark.createDataFrame([(10 * k + i, f"{k} {i}") for i in range(8)], SCHEMA))
    before = sorted(map(str, index.read().collect()))
    index.compact()
    assert sorted(map(str, index.read().collect())) == before
    assert len(index.read().inputFiles()) == 2
    assert ids(E.ingest(index, spark.createDataFrame([(100, "0 1"), (101, "new")], SCHEMA))) == [101]
    fresh = E.DigestIndex(spark.newSession(), "digests_small", f"{tmp_path}/index", 2)
    assert fresh.read().count() == 25
