import os
import re

import pytest
from pyspark.sql import functions as F

from pagestrata.sources.site_store import SCHEMAS, SiteStore


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def filled(spark, path, n=40, shards=8):
    store = SiteStore(spark, path, shards)
    ids = spark.range(n).select(F.md5(F.col("id").cast("string")).alias("operation_id"), "id")
    at = F.expr("timestamp_seconds(id)")
    operations = ids.select("operation_id", F.concat(F.lit("http://x.org/"), "id").alias("url"), F.lit("completed").alias("status"), at.alias("created_at"), at.alias("updated_at"))
    parts = ids.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position"))
    blocks = parts.select(
        "operation_id",
        F.md5(F.concat_ws("|", "operation_id", "position")).alias("block_id"),
        F.lit("content").alias("block_type"),
        F.lit("html5").alias("platform"),
        "position",
        (F.col("position") + 1).alias("block_no"),
        F.lit("{}").alias("content"),
        F.lit("<p>é").alias("html"),
        at.alias("created_at"),
    )
    links = parts.select("operation_id", F.concat(F.lit("/"), "position").alias("url"), (2 - F.col("position")).alias("depth"), at.alias("created_at"))
    tables = {"operations": operations, "blocks": blocks, "links": links}
    for name, rows in tables.items():
        store.add(name, rows)
    return store, tables


def test_adding_again_changes_nothing_and_a_new_session_reads_the_same(spark, tmp_path):
    store, tables = filled(spark, f"{tmp_path}/site")
    before = {name: rows_of(store.table(name).drop("shard")) for name in tables}
    assert before == {name: rows_of(rows) for name, rows in tables.items()}
    for name, rows in tables.items():
        store.add(name, rows.unionByName(rows).repartition(3))
    other = SiteStore(spark.newSession(), f"{tmp_path}/site", 8)
    assert {name: rows_of(other.table(name).drop("shard")) for name in tables} == before
    with pytest.raises(ValueError, match="8 shards"):
        SiteStore(spark, f"{tmp_path}/site", 16)
    with pytest.raises(ValueError, match="columns"):
        store.add("links", tables["links"].withColumn("more", F.lit(1)))


def test_lookups_read_one_shard(spark, tmp_path):
    store, tables = filled(spark, f"{tmp_path}/site")
    one = tables["operations"].first()["operation_id"]
    for name in tables:
        found = store.of(name, one)
        assert rows_of(found) == rows_of(tables[name].where(F.col("operation_id") == one))
        plan = found._jdf.queryExecution().toString()
        assert re.search(r"PartitionFilters: \[isnotnull\(shard#\d+\), \(shard#\d+ = \d\)\]", plan), plan
    assert [r.position for r in store.of("blocks", one).collect()] == [0, 1, 2]
    assert [r.depth for r in store.of("links", one).collect()] == [0, 1, 2]
    block = tables["blocks"].collect()[7]
    found = store.block(block.block_id)
    assert rows_of(found) == [str(block)] or found.first().block_id == block.block_id
    assert "EqualTo(block_id" in found._jdf.queryExecution().toString()
    assert store.of("blocks", "none").count() == store.block("none").count() == 0
    some = tables["operations"].limit(5).select("operation_id").collect()
    wanted = spark.createDataFrame(some)
    assert rows_of(store.of_all("links", wanted)) == rows_of(tables["links"].join(wanted, "operation_id", "left_semi"))


def modified(folder):
    return {os.path.join(top, f): os.stat(os.path.join(top, f)).st_mtime_ns for top, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_a_deletion_cascades_and_touches_only_its_shards(spark, tmp_path):
    store, tables = filled(spark, f"{tmp_path}/site")
    shard = store.table("operations").first()["shard"]
    gone = store.table("operations").where(F.col("shard") == shard).limit(2).select("operation_id")
    gone = spark.createDataFrame(gone.collect())
    before = modified(f"{tmp_path}/site/blocks")
    store.delete(gone)
    for name, rows in tables.items():
        assert rows_of(store.table(name).drop("shard")) == rows_of(rows.join(gone, "operation_id", "left_anti"))
        assert store.orphans(name).count() == 0
    after = modified(f"{tmp_path}/site/blocks")
    assert {f for f in before if f"shard={shard}/" not in f} == {f for f in after if f"shard={shard}/" not in f}
    store.delete(gone)  # again: nothing of them is left
    assert modified(f"{tmp_path}/site/blocks") == after
    whole = store.table("operations").where(F.col("shard") == shard).select("operation_id")
    store.delete(spark.createDataFrame(whole.collect()))  # an emptied shard loses its folder
    assert not any(f"shard={shard}/" in f for f in modified(f"{tmp_path}/site"))
    assert store.orphans("blocks").count() == 0 and store.table("blocks").count() > 0


def test_a_deletion_cut_off_after_the_children_can_be_finished(spark, tmp_path, monkeypatch):
    store, tables = filled(spark, f"{tmp_path}/site")
    gone = spark.createDataFrame(tables["operations"].limit(6).select("operation_id").collect())
    original = SiteStore._rewrite

    def cut_off(self, name, kept, touched):
        if name == "operations":
            raise RuntimeError("lost")
        original(self, name, kept, touched)

    monkeypatch.setattr(SiteStore, "_rewrite", cut_off)
    with pytest.raises(RuntimeError):
        store.delete(gone)
    monkeypatch.setattr(SiteStore, "_rewrite", original)
    assert store.orphans("blocks").count() == 0
    store.delete(gone)
    assert rows_of(store.table("operations").drop("shard")) == rows_of(tables["operations"].join(gone, "operation_id", "left_anti"))


def test_empty_tables_nulls_and_compaction(spark, tmp_path):
    store = SiteStore(spark, f"{tmp_path}/site", 4)
    assert all(store.table(name).count() == 0 for name in SCHEMAS)
    store.add("links", spark.createDataFrame([], SCHEMAS["links"]))
    store.compact("links")
    for url in ("/a", "/b", None, None):
        store.add("links", spark.createDataFrame([(None, url, 1, None), ("x", url, 1, None)], SCHEMAS["links"]))
    assert store.table("links").count() == 6
    before, files = rows_of(store.table("links")), len(modified(f"{tmp_path}/site/links"))
    store.compact("links")
    assert rows_of(store.table("links")) == before and len(modified(f"{tmp_path}/site/links")) < files
    assert store.orphans("links").count() == 6
    with pytest.raises(ValueError, match="no such table"):
        store.table("other")
