import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pagestrata.plans.parse import operations, page_blocks
from pagestrata.plans.reports import bundle_manifest, summary_page
from pagestrata.sources import files
from pagestrata.sources.pages import read_page_files
from pagestrata.sources.store import artefact_rows


def at():
    return F.expr("timestamp_seconds(page_id)")


def tree(folder):
    """Relative path and bytes of every file that a walk finds."""
    found = {}
    for top, _, names in os.walk(folder):
        for name in names:
            path = os.path.join(top, name)
            with open(path, "rb") as file:
                found[os.path.relpath(path, folder)] = file.read()
    return found


def site(spark):
    html = "<!DOCTYPE html><html><header><b>head é {}</b></header><section><p>a section with more than enough words in it to be kept</p></section><footer>f</footer></html>"
    rows = [(i, f"https://h.example.com/{'x' * (i * 40)}?q={i}", html.format(i)) for i in range(12)] + [(90, "", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_page_files_have_the_pages_bytes_and_can_be_read_as_pages(spark, tmp_path):
    pages = site(spark).repartition(5)
    files.write_page_files(pages, f"{tmp_path}/out")
    found = tree(f"{tmp_path}/out")
    assert {n: b.decode() for n, b in found.items()} == {r.path: r.body or "" for r in files.page_file_rows(pages).collect()}
    assert len(found) == 13 and max(len(n.encode()) for n in found) <= 255
    again = read_page_files(spark, f"{tmp_path}/out")
    assert again.columns == ["page_id", "url", "html"] and again.select("page_id").distinct().count() == 12
    assert sorted(r.html for r in again.collect()) == sorted(r.html for r in pages.collect() if r.html)


def test_block_files_and_bundles_equal_their_rows_and_a_second_run_changes_nothing(spark, tmp_path):
    pages = site(spark)
    ops, blocks = operations(pages, at(), at()), page_blocks(pages, at())
    folder = f"file://{tmp_path}/with space"
    receipt = files.save_block_files(blocks, folder.replace(" ", "%20"))
    assert {r.blocks_count for r in receipt.collect()} == {3} and receipt.count() == 12
    rows = {r.path: (r.body or "").encode() for r in artefact_rows(blocks).collect()}
    assert tree(f"{tmp_path}/with space") == rows
    for _ in range(2):
        files.write_bundles(ops, blocks, f"{tmp_path}/with space")
        summaries = {}
        for r in sorted(summary_page(ops, blocks).collect(), key=lambda r: (r.operation_id, r.section, r.platform, r.chunk_no)):
            path = f"blocks/{r.operation_id}/blocks_summary.html"
            summaries[path] = summaries.get(path, b"") + r.text.encode()
        assert tree(f"{tmp_path}/with space") == {**rows, **summaries}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    good = spark.createDataFrame([(f"a/{i}", 0, "x") for i in range(20)], "path string, part int, body string")
    files.write_files(good, f"{tmp_path}/out")
    before = tree(f"{tmp_path}/out")
    for bad in ("../outside", "/abs", "a/../../b", None):
        rows = good.withColumn("body", F.lit("changed")).unionByName(spark.createDataFrame([(bad, 0, "y")], good.schema))
        with pytest.raises(PySparkException):
            files.write_files(rows, f"{tmp_path}/out")
        assert tree(f"{tmp_path}/out") == before and os.listdir(f"{tmp_path}/out") == ["a"]
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_parts_are_joined_in_order_and_empty_tables_give_an_empty_folder(spark, tmp_path):
    rows = spark.createDataFrame([("d/f", i, f"{i},") for i in range(2000)] + [("d/g", 1, None)], "path string, part int, body string").repartition(7)
    files.write_files(rows, f"{tmp_path}/one")
    assert tree(f"{tmp_path}/one") == {"d/f": "".join(f"{i}," for i in range(2000)).encode(), "d/g": b""}
    files.write_files(rows.limit(0), f"{tmp_path}/none")
    assert tree(f"{tmp_path}/none") == {}
    with pytest.raises(ValueError, match="mounted"):
        files.write_files(rows, "hdfs://host/folder")


def test_published_files_are_read_by_relative_path(spark, tmp_path):
    rows = spark.createDataFrame([("a/ü.html", 0, "é"), ("b.html", 0, "")], "path string, part int, body string")
    files.write_files(rows, f"{tmp_path}/out")
    assert sorted(map(tuple, files.read_files(spark, f"{tmp_path}/out").collect())) == [("a/ü.html", 2, "é")]


def test_a_folder_is_one_tasks_unless_it_has_many_files(spark, monkeypatch):
    monkeypatch.setattr(files, "MANY_FILES", 50)
    rows = [(f"d{i}/{j}", 0, "x") for i in range(40) for j in range(6)] + [(f"many/{j}", 0, "x") for j in range(200)] + [(f"{j}", 0, "x") for j in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = files.dealt(spark.createDataFrame(rows, "path string, part int, body string"))
        tasks = dealt.select(F.regexp_extract("path", "^(.*)/", 1).alias("d"), F.spark_partition_id().alias("t")).groupBy("d").agg(F.count_distinct("t").alias("n"), F.count("*").alias("rows"))
        found = {r.d: (r.n, r.rows) for r in tasks.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(found[f"d{i}"] == (1, 6) for i in range(40))
    assert found["many"] == found[""] == (4, 200)


def test_tasks_list_the_files_at_any_depth_and_pass_over_hidden_ones(spark, tmp_path):
    for path in ("top", "a/1", "a/b/c/d/deep", "a/empty", "_staging-x/1", "a/_hidden", "a/.hidden", "a/k=1/_k=2"):
        at_ = tmp_path / "out" / path
        at_.parent.mkdir(parents=True, exist_ok=True)
        at_.write_text("" if path == "a/empty" else path)
    read = files.read_files(spark, f"{tmp_path}/out")
    assert sorted((r.path, r.bytes, r.body) for r in read.collect()) == [(p, len(p), p) for p in ("a/1", "a/b/c/d/deep", "a/k=1/_k=2", "top")]
    assert read.inputFiles() == []  # the driver has listed nothing
    with pytest.raises(FileNotFoundError):
        files.read_files(spark, f"{tmp_path}/none")


def counted(blocks):
    """The blocks, and a counter of how often a row of them was made."""
    made = blocks.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return blocks.mapInArrow(count, blocks.schema), made


def test_blocks_are_made_once_for_all_files_and_pages_of_a_bundle(spark, tmp_path):
    pages = site(spark)
    ops, n = operations(pages, at(), at()), 36
    blocks, made = counted(page_blocks(pages, at()))
    files.save_block_files(blocks, f"{tmp_path}/blocks").collect()
    assert made.value == n
    files.write_bundles(ops, blocks, f"{tmp_path}/bundles")
    assert made.value == 2 * n
    assert bundle_manifest(ops, blocks).count() == 2 * n + 4 * 12 + 13
    assert made.value == 3 * n
    assert summary_page(ops, blocks).count() == 4 * 12 + 13
    assert made.value == 4 * n
