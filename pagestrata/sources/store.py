"""Stored tables: operations, blocks, links, status log, artefacts; their sinks, checks and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from pagestrata.functions.json_text import indented_content, indented_object
from pagestrata.rules import BLOCK_TYPES, PLATFORMS, STATUSES


# -- status -----------------------------------------------------------------


def current_status(log: DataFrame) -> DataFrame:
    """Latest status per operation; a later event of the same instant wins by its id."""
    latest = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id"))
    return log.groupBy("operation_id").agg(latest.alias("s")).select(
        "operation_id", "s.status", F.col("s.ts").alias("updated_at")
    )


ALLOWED_STEPS = {
    "pending": ("processing",),
    "processing": ("completed", "error"),
    "completed": (),
    "error": (),
}


def status_steps(log: DataFrame) -> DataFrame:
    """Each event with the status before it and whether that step is allowed; repeats are.

    The previous event is the greatest one before it, found by a merge over
    hourly slots, so a job's events are sorted by hour; one hour of one job is one task's.
    """
    slot = F.date_trunc("hour", F.col("ts"))
    events = log.withColumn("__slot", slot)
    order = [F.col("ts"), F.col("event_id")]
    inside = Window.partitionBy("operation_id", "__slot").orderBy(*order)
    events = events.withColumn("__before", F.lag("status").over(inside))
    last = F.max_by("status", F.struct("ts", "event_id")).alias("__last")
    slots = events.groupBy("operation_id", "__slot").agg(last)
    earlier = Window.partitionBy("operation_id").orderBy("__slot")
    slots = slots.select("operation_id", "__slot", F.lag("__last").over(earlier).alias("__slot_before"))
    joined = events.join(slots, ["operation_id", "__slot"])
    before = F.coalesce("__before", "__slot_before")
    allowed = F.lit(False)
    for name, following in ALLOWED_STEPS.items():
        allowed = allowed | ((before == name) & F.col("status").isin(name, *following))
    first = before.isNull() & (F.col("status") == "pending")
    return joined.select(
        "operation_id", "event_id", "ts", before.alias("before"), "status", F.coalesce(allowed | first, F.lit(False)).alias("allowed")
    )


# -- sinks ------------------------------------------------------------------


def write_blocks(blocks: DataFrame, path: str, mode: str = "append") -> None:
    """Block sink, partitioned the way blocks are looked up."""
    blocks.write.mode(mode).partitionBy("platform", "block_type").parquet(path)


def append_operations(operations: DataFrame, path: str) -> None:
    """Operation sink."""
    operations.write.mode("append").parquet(path)


def write_artefacts(blocks: DataFrame, path: str, mode: str = "append") -> None:
    """Artefact sink: the files of each block as rows, by kind."""
    artefact_rows(blocks).write.mode(mode).partitionBy("kind").parquet(path)


def new_links(links: DataFrame, stored_links: DataFrame | None = None) -> DataFrame:
    """Links to append: once per operation and URL, and not stored before."""
    fresh = links.dropDuplicates(["operation_id", "url"])
    if stored_links is None:
        return fresh
    return fresh.join(stored_links.select("operation_id", "url"), ["operation_id", "url"], "left_anti")


def artefact_rows(blocks: DataFrame) -> DataFrame:
    """Two files per block: its markup and its metadata."""
    stem = F.concat_ws("_", "block_type", "block_id")
    folder = F.concat(F.lit("blocks/"), F.col("operation_id"), F.lit("/"))
    files = F.array(
        F.struct(
            F.concat(folder, stem, F.lit(".html")).alias("path"), F.lit("html").alias("kind"), F.col("html").alias("body")
        ),
        F.struct(
            F.concat(folder, stem, F.lit("_metadata.json")).alias("path"),
            F.lit("metadata").alias("kind"),
            metadata_json().alias("body"),
        ),
    )
    return blocks.select("operation_id", "block_id", F.explode(files).alias("f")).select(
        "operation_id", "block_id", "f.path", "f.kind", "f.body"
    )


def rfc3339(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ssXXX")


def metadata_json(with_html: bool = False) -> Column:
    """Indented JSON document of a block, keys in alphabetical order."""
    keys = {
        "block_type": F.col("block_type"),
        "content": indented_content("  "),
        "created_at": rfc3339("created_at"),
        **({"html": F.col("html")} if with_html else {}),
        "id": F.col("block_id"),
        "operation_id": F.col("operation_id"),
        "platform": F.col("platform"),
    }
    return indented_object(keys, raw=("content",))


# -- constraints ------------------------------------------------------------


def _checks(table: str) -> list[tuple[str, Column]]:
    """Constraints of operations, blocks or links in the order they are tried: name, and when it is broken."""
    if table == "links":
        return [(name, F.col(name).isNull()) for name in ("operation_id", "url", "depth")]
    if table == "operations":
        return [("url", F.col("url").isNull()), ("status", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))]
    return [
        ("operation_id", F.col("operation_id").isNull()),
        ("block_type", ~F.coalesce(F.col("block_type").isin(*BLOCK_TYPES), F.lit(False))),
        ("platform", ~F.coalesce(F.col("platform").isin(*PLATFORMS, "unknown"), F.lit(False))),
        ("content", F.col("content").isNull()),
        ("html", F.col("html").isNull()),
    ]


def violation(table: str = "blocks") -> Column:
    """Name of the first constraint that a row of operations, blocks or links breaks, or null."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(_checks(table)):
        reason = F.when(broken, F.lit(name)).otherwise(reason)
    return reason


def write_checked(rows: DataFrame, table: str, path: str) -> dict[str, int]:
    """Write ``rows`` once, split by whether they meet all constraints; rows by reason, ``rows`` in all, from the same pass.

    The table at ``path`` has the rows' columns, the ``reason`` (null for valid rows) and the partition ``valid`` ('true' or 'false'). An existing table is
    refused, as are rows that have columns of these names.
    """
    clash = {"reason", "valid"} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the way")
    seen = Observation()
    counts = [F.count_if(F.col("reason") == name).alias(name) for name, _ in _checks(table)]
    marked = rows.withColumn("reason", violation(table)).observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    marked.withColumn("valid", F.col("reason").isNull()).write.partitionBy("valid").parquet(path)
    return dict(seen.get)


def split_valid(rows: DataFrame, table: str = "blocks") -> tuple[DataFrame, DataFrame]:
    """Rows that meet all constraints, and the others with the ``reason``."""
    marked = rows.withColumn("reason", violation(table))
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def without_operations(children: DataFrame, deleted: DataFrame) -> DataFrame:
    """Cascade: children of operations that are not deleted."""
    return children.join(deleted.select("operation_id"), "operation_id", "left_anti")


def orphans(children: DataFrame, operations: DataFrame) -> DataFrame:
    return children.join(operations.select("operation_id"), "operation_id", "left_anti")


# -- lookups ----------------------------------------------------------------


def operation_by_id(operations: DataFrame, operation_id: str) -> DataFrame:
    return operations.filter(F.col("operation_id") == operation_id)


def newest_operations(operations: DataFrame) -> DataFrame:
    return operations.orderBy(F.desc("created_at"), "operation_id")


def blocks_of(blocks: DataFrame, operation_id: str | Column) -> DataFrame:
    return blocks.filter(F.col("operation_id") == operation_id).orderBy("created_at", "position")


def block_by_id(blocks: DataFrame, block_id: str | Column) -> DataFrame:
    return blocks.filter(F.col("block_id") == block_id)


def links_of(links: DataFrame, operation_id: str | Column) -> DataFrame:
    return links.filter(F.col("operation_id") == operation_id).orderBy("depth", "created_at", "url")


def operation_results(operations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Operations with their blocks, one row per block; an operation without blocks has one row."""
    found = blocks.select("operation_id", "block_id", "block_type", "block_no", "content")
    return operations.select("operation_id", "url", "status").join(found, "operation_id", "left")


def owned_blocks(blocks: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (operation_id, block_id) that name a block of that operation."""
    return claims.join(blocks.select("operation_id", "block_id"), ["operation_id", "block_id"], "left_semi")


def file_listing(artefacts: DataFrame) -> DataFrame:
    """Files of each operation by kind, one row per file, with the number of files of that kind and in all."""
    folder = F.concat(F.lit("blocks/"), F.col("operation_id"), F.lit("/"))
    name = F.expr("substring(path, length(concat('blocks/', operation_id, '/')) + 1)")
    files = artefacts.filter(F.startswith("path", folder)).select("operation_id", "kind", name.alias("file"))
    counts = files.groupBy("operation_id").agg(
        F.count_if(F.col("kind") == "html").alias("html_files"),
        F.count_if(F.col("kind") == "metadata").alias("metadata_files"),
        F.count("*").alias("total"),
    )
    return files.join(counts, "operation_id")


def artefact_body(artefacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """First file by path that holds the block id, per wanted (operation_id, block_id, kind); empty ones do not count."""
    hits = artefacts.join(wanted, ["operation_id", "block_id", "kind"], "left_semi")
    first = hits.groupBy("operation_id", "block_id", "kind").agg(F.min_by(F.struct("path", "body"), "path").alias("f"))
    return first.filter(F.octet_length("f.body") > 0).select("operation_id", "block_id", "kind", "f.path", "f.body")
