"""Page sources and the raw-page sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagestrata.functions.urls import file_key

PAGE_COLUMNS = ("page_id", "url", "html")


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Stored pages: any table format with ``page_id, url, html``."""
    return spark.read.format(format).load(path).select(*PAGE_COLUMNS)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Saved page files, one page per file; the path stands for the URL."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    html = F.decode("content", "UTF-8")
    return files.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), html.alias("html"))


def raw_files(pages: DataFrame) -> DataFrame:
    """Rows of the raw-page sink: file key, unique file name, bytes and text."""
    key = file_key(F.col("url"))
    return pages.select(
        "page_id",
        key.alias("file_key"),
        F.concat(key, F.lit("."), F.col("page_id").cast("string"), F.lit(".html")).alias("file_name"),
        F.octet_length("html").alias("bytes"),
        "html",
    )


def write_raw_files(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Raw-page sink: one row per page with its file name and text."""
    raw_files(pages).write.mode(mode).parquet(path)


def key_collisions(pages: DataFrame) -> DataFrame:
    """File keys that several pages share."""
    keyed = pages.select(file_key(F.col("url")).alias("file_key"))
    return keyed.groupBy("file_key").agg(F.count("*").alias("pages")).filter(F.col("pages") > 1)
