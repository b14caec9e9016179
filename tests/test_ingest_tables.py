import os

import pytest
from pyspark.sql import functions as F

from pagestrata.operators.links import page_links
from pagestrata.plans.parse import outcomes, page_blocks
from pagestrata.sources.store import artefact_rows
from pagestrata.streaming import ingest as I

HTML = "<!DOCTYPE html><html><header><b>head {}</b></header><section><p>a section with more than enough words in it to be kept</p><a href=/a>a</a><a href='/a#x'>a</a><a href='b/{}'>b</a></section><footer>f</footer></html>"


def at():
    return F.expr("timestamp_seconds(page_id)")


def pages_of(spark):
    rows = [(i, f"http://x.org/{i}", HTML.format(i, i) if i % 5 else None if i % 2 else "<p>unknown <a href='/u'>u</a>") for i in range(20)]
    return spark.createDataFrame(rows, I.PAGE_SCHEMA)


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def tables(spark, out):
    return {name: rows_of(I.stored_table(spark, out, name)) for name in I.TABLES}


def test_stream_equals_batch_in_all_tables(spark, tmp_path):
    pages = pages_of(spark)
    pages.repartition(4).write.parquet(f"{tmp_path}/in")
    I.ingest_tables(I.page_stream(spark, f"{tmp_path}/in", max_files=1), f"{tmp_path}/out", f"{tmp_path}/log", at()).awaitTermination()
    found = tables(spark, f"{tmp_path}/out")
    blocks = page_blocks(pages, at())
    assert found["blocks"] == rows_of(blocks)
    assert found["artefacts"] == rows_of(artefact_rows(blocks))
    want = outcomes(pages, at(), at())
    assert rows_of(I.stored_table(spark, f"{tmp_path}/out", "operations").drop("platform")) == rows_of(want)
    assert want.where("status = 'error'").count() == 2
    links = page_links(pages).where("link IS NOT NULL").select("url", "link").distinct().count()
    assert len(found["links"]) == links
    counts = I.ledger(spark, f"{tmp_path}/out").agg(*(F.sum(t).alias(t) for t in I.TABLES)).first()
    assert {t: counts[t] for t in I.TABLES} == {t: len(r) for t, r in found.items()}
    assert I.ledger(spark, f"{tmp_path}/out").count() == 4


def test_a_batch_again_changes_nothing_even_if_the_first_run_was_cut_off(spark, tmp_path):
    pages, out = pages_of(spark), f"{tmp_path}/out"
    assert I.store_batch(pages.where("page_id < 10"), 0, out, at())
    assert I.store_batch(pages.where("page_id >= 10"), 1, out, at())
    before = tables(spark, out)
    assert not I.store_batch(pages, 1, out, at())  # in the ledger: its rows are not even read
    assert tables(spark, out) == before
    os.remove(f"{out}/ledger/batch=1/_SUCCESS")  # a driver lost just before the ledger was done
    assert I.store_batch(pages.where("page_id >= 10").repartition(3), 1, out, at())
    assert tables(spark, out) == before


def test_tables_of_an_unfinished_batch_are_not_seen(spark, tmp_path):
    pages, out = pages_of(spark), f"{tmp_path}/out"
    I.store_batch(pages.where("page_id < 10"), 0, out, at())
    before = tables(spark, out)
    page_blocks(pages, at()).write.parquet(f"{out}/blocks/batch=1")
    assert tables(spark, out) == before
    with pytest.raises(ValueError, match="no such table"):
        I.stored_table(spark, out, "parsed")


def test_no_templates_is_an_error_of_plain_pages_and_an_empty_batch_counts_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    I.store_batch(pages_of(spark), 0, out, at(), templates=())
    states = {(r.platform, r.status, r.error) for r in I.stored_table(spark, out, "operations").collect()}
    assert states == {("html5", "error", "no templates"), ("unknown", "completed", None), ("unknown", "error", "no page")}
    I.store_batch(pages_of(spark).limit(0), 1, out, at())
    assert tuple(I.ledger(spark, out).where("batch = 1").select(*I.TABLES).first()) == (0, 0, 0, 0)


def test_a_batch_of_one_file_is_parsed_by_many_tasks(spark, tmp_path):
    out = f"{tmp_path}/out"
    I.store_batch(pages_of(spark).coalesce(1), 0, out, at())
    assert spark.read.parquet(f"{out}/parsed/batch=0").select(F.input_file_name()).distinct().count() > 1
