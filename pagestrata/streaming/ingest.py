"""Pages as a stream: files that arrive are parsed once, and operations, blocks, links and artefacts stored.

``ingest`` appends blocks alone. ``ingest_tables`` keeps all tables of a site: each micro-batch is read once into a staged table, from which every table's part of that batch
is written into a folder of its own (``<table>/batch=<n>``); the batch then enters the ledger. A batch that is run again after a crash finds itself in the ledger, or writes the
same folders over. Readers see the batches that the ledger has.

Nulls: a page without html becomes an operation with status error and nothing else; a null url or id is carried. Repeated rows of a page are operations of one id, as
in a batch job. An empty batch enters the ledger with counts of zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pagestrata.functions.urls import resolved_link, url_parts
from pagestrata.operators.templates import read_templates
from pagestrata.plans.parse import block_rows, operation_id, page_blocks, with_page_blocks
from pagestrata.rules import Template
from pagestrata.sources.store import artefact_rows

PAGE_SCHEMA = "page_id bigint, url string, html string"
TABLES = ("operations", "blocks", "links", "artefacts")


def page_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New page files of a folder; each trigger takes at most ``max_files``."""
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def ingest(pages: DataFrame, out: str, checkpoint: str, created_at: Column) -> StreamingQuery:
    """Parse arriving pages and append their blocks, each page once: the checkpoint and the file sink see to it."""
    blocks = page_blocks(pages, created_at)
    return (
        blocks.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .partitionBy("platform", "block_type")
        .trigger(availableNow=True)
        .start()
    )


# -- all tables ----------------------------------------------------------------------


def parsed_operations(parsed: DataFrame, some_templates: bool) -> DataFrame:
    """Operations of parsed pages with their outcome: completed, or error with its reason."""
    error = F.when(F.col("html").isNull(), "no page").when((F.col("platform") == "html5") & F.lit(not some_templates), "no templates")
    return parsed.select(
        operation_id(F.col("url"), F.col("page_id")).alias("operation_id"),
        "url",
        "platform",
        F.when(error.isNull(), "completed").otherwise("error").alias("status"),
        error.alias("error"),
        F.col("__at").alias("created_at"),
        F.col("__at").alias("updated_at"),
    )


def parsed_links(parsed: DataFrame) -> DataFrame:
    """Links of parsed pages, each resolved address once per operation, at the place of its first link."""
    base = parsed.withColumn("__base", url_parts(F.col("url")))
    found = F.array_distinct(F.filter(F.transform("hrefs", lambda h: resolved_link(F.col("__base"), h)), lambda u: u.isNotNull()))
    rows = base.select(operation_id(F.col("url"), F.col("page_id")).alias("operation_id"), F.posexplode(found).alias("link_no", "link"), "__at")
    return rows.select("operation_id", F.col("link").alias("url"), "link_no", F.lit(1).alias("depth"), F.col("__at").alias("created_at"))


def _in_ledger(spark: SparkSession, out: str, batch: int) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/ledger/batch={batch}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _parsed(pages: DataFrame, created_at: Column, templates: Sequence[Template]) -> DataFrame:
    """Parsed pages, dealt over all cores first, since a batch may have fewer files than there are cores."""
    dealt = pages.withColumn("__at", created_at).repartition(2 * pages.sparkSession.sparkContext.defaultParallelism)
    return with_page_blocks(dealt, templates=templates, links=True)


def store_batch(pages: DataFrame, batch: int, out: str, created_at: Column, templates: Sequence[Template] | None = None) -> bool:
    """Parse a batch of pages once and store its part of every table; False if the ledger had the batch already."""
    templates = read_templates() if templates is None else templates
    return _store(_parsed(pages, created_at, templates), batch, out, bool(templates))


def _store(read: DataFrame, batch: int, out: str, some_templates: bool) -> bool:
    spark = read.sparkSession
    if _in_ledger(spark, out, batch):
        return False
    staged = f"{out}/parsed/batch={batch}"
    read.write.mode("overwrite").parquet(staged)
    parsed = spark.read.schema(read.schema).parquet(staged)
    blocks = block_rows(parsed)
    tables = {"operations": parsed_operations(parsed, some_templates), "blocks": blocks, "links": parsed_links(parsed), "artefacts": artefact_rows(blocks)}
    counts = {}
    for name in TABLES:
        seen = Observation(name)
        rows = tables[name].observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
        counts[name] = seen.get["rows"]
    line = spark.range(1).select(*(F.lit(counts[name]).cast("long").alias(name) for name in TABLES))
    line.coalesce(1).write.mode("overwrite").parquet(f"{out}/ledger/batch={batch}")
    return True


def ingest_tables(pages: DataFrame, out: str, checkpoint: str, created_at: Column, templates: Sequence[Template] | None = None) -> StreamingQuery:
    """Store all tables of arriving pages below ``out``, each batch once. The parse is planned once for all batches."""
    templates = read_templates() if templates is None else templates
    parsed = _parsed(pages, created_at, templates)

    def store(batch: DataFrame, number: int) -> None:
        _store(batch, number, out, bool(templates))

    return parsed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """(operations, blocks, links, artefacts, batch): rows of each stored batch."""
    return spark.read.option("basePath", f"{out}/ledger").parquet(f"{out}/ledger")


def stored_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of a table from the batches that the ledger has."""
    if name not in TABLES:
        raise ValueError(f"no such table: {name}")
    rows = spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}")
    return rows.join(ledger(spark, out).select("batch"), "batch", "left_semi").drop("batch")
