"""Operations, blocks and links as stored tables that lookups prune and deletions rewrite in part.

All tables are partitioned by ``shard``, a hash of the operation, and sorted by operation inside their files, with Parquet bloom filters on ids. A lookup by operation lists one folder; a lookup of a block
skips row groups by filter. Rows are added by key, so adding the same rows again changes nothing. Deleting operations rewrites the shards that
hold them and no others, children before operations, so that a deletion which was cut off leaves no orphans and can be run again.

One writer at a time. Nulls: a row without operation id lies in the shard of an empty id; null keys are equal keys. Repeated rows are stored once. Empty tables add nothing. Columns beside a table's own are an error on writing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagestrata.session import stored

SCHEMAS = {
    "operations": "operation_id string, url string, status string, created_at timestamp, updated_at timestamp",
    "blocks": "operation_id string, block_id string, block_type string, platform string, position int, block_no int, content string, html string, created_at timestamp",
    "links": "operation_id string, url string, depth int, created_at timestamp",
}
KEYS = {"operations": ["operation_id"], "blocks": ["operation_id", "block_id"], "links": ["operation_id", "url"]}
_ORDER = {"operations": ["operation_id"], "blocks": ["operation_id", "position"], "links": ["operation_id", "depth", "url"]}


@dataclass(frozen=True)
class SiteStore:
    """Tables below a folder; ``shards`` is fixed for the life of the store."""

    spark: SparkSession
    path: str
    shards: int = 64

    def __post_init__(self):
        meta = f"{self.path}/meta"
        if self._exists(f"{meta}/_SUCCESS"):
            found = self.spark.read.schema("shards int").parquet(meta).first()["shards"]
            if found != self.shards:
                raise ValueError(f"the store at {self.path} has {found} shards, not {self.shards}")
        else:
            self.spark.range(1).select(F.lit(self.shards).cast("int").alias("shards")).coalesce(1).write.mode("overwrite").parquet(meta)

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _shard(self, operation_id: Column | str) -> Column:
        value = F.col(operation_id) if isinstance(operation_id, str) else operation_id
        return F.pmod(F.xxhash64(F.coalesce(value, F.lit(""))), F.lit(self.shards)).cast("int")

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, name: str) -> DataFrame:
        """All rows of a table, with their ``shard``."""
        if name not in SCHEMAS:
            raise ValueError(f"no such table: {name}")
        schema = f"{SCHEMAS[name]}, shard int"
        if not self._exists(self._folder(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self._folder(name)).parquet(self._folder(name))

    # -- writing ----------------------------------------------------------------------

    def _write(self, rows: DataFrame, name: str, mode: str) -> None:
        dealt = rows.hint("rebalance", "shard").sortWithinPartitions("shard", *_ORDER[name])
        writer = dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("shard")
        for key in KEYS[name]:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(self._folder(name))

    def add(self, name: str, rows: DataFrame) -> None:
        """Add the rows whose key the table has not; of rows of one key one is added. Only shards that the rows touch are read."""
        fields = [f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema]
        if set(rows.columns) != set(fields):
            raise ValueError(f"{name} has the columns {', '.join(fields)}")
        fresh = stored(rows.select(*fields).withColumn("shard", self._shard("operation_id")).dropDuplicates(KEYS[name]), f"add-{name}")
        touched = [r["shard"] for r in fresh.select("shard").distinct().collect()]  # at most the number of shards
        if not touched:
            return
        keys = ["shard", *KEYS[name]]
        before = self.table(name).where(F.col("shard").isin(touched)).select(*(F.col(k).alias(f"_{k}") for k in keys))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        new = fresh.join(before, same, "left_anti")
        self._write(stored(new, f"new-{name}"), name, "append")

    def _rewrite(self, name: str, kept: DataFrame, touched: list[int]) -> None:
        """Replace the touched shards by the kept rows; a shard that has none left loses its folder."""
        rows = stored(kept, f"kept-{name}")
        left = {r["shard"] for r in rows.select("shard").distinct().collect()}
        self._write(rows, name, "overwrite")
        for shard in sorted(set(touched) - left):
            fs, at = self._fs(f"{self._folder(name)}/shard={shard}")
            fs.delete(at, True)

    def delete(self, operations: DataFrame) -> None:
        """Delete operations, given by ``operation_id``, with their blocks and links."""
        gone = stored(operations.select("operation_id").distinct().withColumn("shard", self._shard("operation_id")), "deleted")
        touched = [r["shard"] for r in gone.select("shard").distinct().collect()]
        ids = gone.select(F.col("operation_id").alias("_id"), F.col("shard").alias("_shard"))
        same = (F.col("shard") == F.col("_shard")) & F.col("operation_id").eqNullSafe(F.col("_id"))
        for name in ("blocks", "links", "operations"):
            rows = self.table(name).where(F.col("shard").isin(touched))
            has = [r["shard"] for r in rows.join(ids, same, "left_semi").select("shard").distinct().collect()]
            if has:
                self._rewrite(name, rows.where(F.col("shard").isin(has)).join(ids, same, "left_anti"), has)

    def compact(self, name: str) -> None:
        """Write each shard of a table anew, its rows in order in as few files as fit."""
        if self._exists(self._folder(name)):
            rows = self.table(name)
            self._rewrite(name, rows, [r["shard"] for r in rows.select("shard").distinct().collect()])

    # -- lookups ----------------------------------------------------------------------

    def of(self, name: str, operation_id: str) -> DataFrame:
        """Rows of one operation, read from its shard alone, in order: blocks by time and place, links by depth and time."""
        own = F.lit(operation_id).cast("string")
        rows = self.table(name).where((F.col("shard") == self._shard(own)) & (F.col("operation_id") == own)).drop("shard")
        order = {"operations": ["operation_id"], "blocks": ["created_at", "position"], "links": ["depth", "created_at", "url"]}
        return rows.orderBy(*order[name])

    def of_all(self, name: str, operations: DataFrame) -> DataFrame:
        """Rows of many operations, given by ``operation_id``."""
        ids = operations.select("operation_id").distinct().withColumn("shard", self._shard("operation_id"))
        return self.table(name).join(ids, ["shard", "operation_id"], "left_semi").drop("shard")

    def block(self, block_id: str) -> DataFrame:
        """The block of an id; row groups without it are skipped by their bloom filters."""
        return self.table("blocks").where(F.col("block_id") == block_id).drop("shard")

    def orphans(self, name: str) -> DataFrame:
        """Rows whose operation is not stored."""
        ids = self.table("operations").select("shard", "operation_id")
        return self.table(name).join(ids, ["shard", "operation_id"], "left_anti").drop("shard")
