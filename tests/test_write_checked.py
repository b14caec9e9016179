"""Rows written once, valid ones and the others apart, with counts of the same pass."""

import pytest

from pagestrata.sources.store import split_valid, write_checked

LINKS = [("a", "u", 1), ("a", None, 1), ("b", "u", None), (None, None, None), ("a", "u", 1)]


def test_one_write_gives_both_sides_and_their_counts(spark, tmp_path):
    rows = spark.createDataFrame(LINKS, "operation_id string, url string, depth int")
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    counts = write_checked(rows.mapInArrow(counted, rows.schema), "links", str(tmp_path / "t"))
    assert counts == {"rows": 5, "operation_id": 1, "url": 1, "depth": 1} and passes.value == 5
    stored = spark.read.parquet(str(tmp_path / "t"))
    valid, others = split_valid(rows, "links")
    assert sorted(map(tuple, stored.where("valid = 'true'").drop("valid", "reason").collect())) == sorted(map(tuple, valid.collect()))
    assert sorted(r.reason for r in stored.where("valid = 'false'").collect()) == sorted(r.reason for r in others.collect())


def test_an_existing_table_and_clashing_columns_are_refused(spark, tmp_path):
    rows = spark.createDataFrame(LINKS, "operation_id string, url string, depth int")
    write_checked(rows.limit(0), "links", str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists"):
        write_checked(rows, "links", str(tmp_path / "t"))
    with pytest.raises(ValueError):
        write_checked(rows.selectExpr("*", "1 AS Reason"), "links", str(tmp_path / "u"))
