"""Shared helpers: tables, work folder, Arrow tasks, joins with hot keys."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A key with more than this share of all rows is joined by broadcast; fewer than 1 / share keys can be.
HOT_SHARE = 0.001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all tasks run in the driver, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='llm-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, so that two spellings of one place are equal."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release_memory() -> None:
    """Give memory that Arrow and the C library hold but do not use back to the system; a worker lives through many stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark hand rows to Python tasks in batches of at most so many, for tables of whole texts; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made
                del made, batch
                release_memory()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """Texts one at a time; null is empty."""
    for text in batch.column(name):
        yield text.as_py() or ""


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of texts one at a time; null is empty."""
    column = batch.column(name).cast(pa.large_binary())
    for text in column:
        yield text.as_py() or b""


def with_hot(many: DataFrame, one: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join of many rows to one row per key (null keys are equal).

    ``weight`` of ``one`` is the number of rows of ``many`` that have its key. Keys with over
    HOT_SHARE of all rows, fewer than 1 / HOT_SHARE by that definition, are joined by broadcast, so
    that their rows need not meet in one task; all others by sort and merge. ``weight`` is dropped.
    """
    hot_at = max(total * HOT_SHARE, 1000)
    hot = one.where(F.col(weight) > hot_at).drop(weight)
    rest = one.where(F.col(weight) <= hot_at).drop(weight)
    names = [c for c in hot.columns if c != key]
    first = many.join(
        F.broadcast(hot.select(F.col(key).alias("_hot"), F.struct(*names).alias("_found"))), F.col(key).eqNullSafe(F.col("_hot")), "left"
    ).drop("_hot")
    found = first.where(F.col("_found").isNotNull()).select(*many.columns, *(F.col("_found")[n].alias(n) for n in names))
    left = first.where(F.col("_found").isNull()).drop("_found")
    rest = rest.withColumnRenamed(key, "_key")
    return found.unionByName(left.join(rest.hint("merge"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
