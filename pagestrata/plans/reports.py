"""Reports over stored operations and blocks.

A report of one operation is a document; here all reports are made in one job,
as rows ``(operation_id, chunk_no, text)`` whose texts, put together in order,
are the document.  No document is collected into one row, so an operation with
very many blocks is spread like any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagestrata.functions.json_text import indented_content
from pagestrata.functions.text import byte_cut, html_safe_json
from pagestrata.session import stored
from pagestrata.sources.store import artefact_rows, metadata_json, rfc3339, write_artefacts

SHEET_CELL_BYTES = 32767
REPORT_JSON_BYTES = 500
REPORT_HTML_BYTES = 1000
# Marks of a cut cell and of empty markup.
CUT_CELL = "...\n[Превышен лимит символов Excel]"
EMPTY = "[Пусто]"


def _seconds(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def _text(*parts: str | Column) -> Column:
    """Concatenation; strings are text, columns are columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# -- sheets -----------------------------------------------------------------


def operation_sheet(operations: DataFrame) -> DataFrame:
    return operations.select(
        "operation_id", "url", "status", rfc3339("created_at").alias("created_at"), rfc3339("updated_at").alias("updated_at")
    )


def block_sheet(blocks: DataFrame) -> DataFrame:
    """Full block sheet: content as JSON, markup cut to what a cell can hold."""
    cut = byte_cut(F.col("html"), SHEET_CELL_BYTES)
    preview = F.when(
        F.octet_length("html") > SHEET_CELL_BYTES, _text(cut, CUT_CELL)
    ).otherwise(F.col("html"))
    return blocks.select(
        "operation_id",
        "block_id",
        "block_type",
        "platform",
        rfc3339("created_at").alias("created_at"),
        html_safe_json(F.col("content")).alias("content"),
        preview.alias("html_preview"),
    )


def short_block_sheet(blocks: DataFrame) -> DataFrame:
    """Short block sheet: template name or N/A, and the content."""
    return blocks.select(
        "operation_id",
        "block_id",
        "block_type",
        "platform",
        rfc3339("created_at").alias("created_at"),
        F.coalesce(F.get_json_object("content", "$.template_name"), F.lit("N/A")).alias("template_name"),
        F.col("content").alias("components"),
    )


def statistics(blocks: DataFrame) -> DataFrame:
    """Blocks per type, per platform and in all, of each operation, in one pass."""
    grouped = blocks.groupingSets(
        [["operation_id", "block_type"], ["operation_id", "platform"], ["operation_id"]],
        "operation_id",
        "block_type",
        "platform",
    ).agg(F.count("*").alias("blocks"), F.grouping("block_type").alias("no_type"), F.grouping("platform").alias("no_platform"))
    section = F.when(F.col("no_type") == 0, "type").when(F.col("no_platform") == 0, "platform").otherwise("total")
    name = F.when(F.col("no_type") == 0, F.col("block_type")).when(F.col("no_platform") == 0, F.col("platform"))
    return grouped.select("operation_id", section.alias("section"), name.alias("name"), "blocks")


# -- text reports -----------------------------------------------------------


def _counts(blocks: DataFrame) -> DataFrame:
    """One row per operation: its counts as lines ``section name blocks``, whatever types and platforms there are."""
    found = F.sort_array(F.collect_list(F.struct("section", "name", "blocks")))
    counts = statistics(blocks).groupBy("operation_id").agg(found.alias("counts"))
    lines = F.transform("counts", lambda c: F.concat_ws(" ", c["section"], c["name"], c["blocks"].cast("string")))
    return counts.select("operation_id", F.array_join(lines, "\n").alias("lines"))


def text_report(operations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Full text report: chunk 0 is the head with statistics, chunk n the n-th block."""
    ops = operations.join(_counts(blocks), "operation_id", "left")
    head = F.concat_ws(
        "\n",
        _text("operation ", F.col("operation_id")),
        _text("url ", F.col("url")),
        _text("status ", F.col("status")),
        _text("created ", _seconds("created_at")),
        _text("updated ", _seconds("updated_at")),
        F.coalesce("lines", F.lit("total 0")),
        F.lit(""),
    )
    heads = ops.select("operation_id", F.lit(0).alias("chunk_no"), head.alias("text"))
    blocks = blocks.withColumn("__json", indented_content("  "))
    body = F.concat_ws(
        "\n",
        _text("block ", F.col("block_no").cast("string"), " ", F.col("block_id")),
        F.concat_ws(" ", F.col("block_type"), F.col("platform"), _seconds("created_at")),
        _previewed(F.col("__json"), REPORT_JSON_BYTES),
        F.when(F.col("html") == "", F.lit(EMPTY)).otherwise(_previewed(F.col("html"), REPORT_HTML_BYTES)),
        F.lit(""),
    )
    return heads.unionByName(blocks.select("operation_id", F.col("block_no").alias("chunk_no"), body.alias("text")))


def _previewed(text: Column, limit: int) -> Column:
    """Text, or its first bytes and a mark of how many there are."""
    cut = _text(byte_cut(text, limit), " ... of ", F.octet_length(text).cast("string"), " bytes")
    return F.when(F.octet_length(text) > limit, cut).otherwise(text)


def short_text_report(operations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Short text report with the full markup of each block."""
    head = F.concat_ws("\n", "operation_id", "url", "status", rfc3339("created_at"), rfc3339("updated_at"), F.lit(""))
    body = F.concat_ws("\n", "block_id", "block_type", "platform", rfc3339("created_at"), "html", F.lit(""))
    heads = operations.select("operation_id", F.lit(0).alias("chunk_no"), head.alias("text"))
    return heads.unionByName(blocks.select("operation_id", F.col("block_no").alias("chunk_no"), body.alias("text")))


# -- block documents --------------------------------------------------------


def _file_name(ending: str) -> Column:
    return F.concat(F.lit("block_"), F.col("block_type"), F.lit("_"), F.col("block_id"), F.lit(ending))


def block_html_document(blocks: DataFrame) -> DataFrame:
    """Each block as an HTML document: its facts as a definition list, its content, its markup."""
    facts = [("id", F.col("block_id")), ("operation", F.col("operation_id")), ("type", F.col("block_type")), ("platform", F.col("platform")), ("created", _seconds("created_at"))]
    items = F.concat(*[_text(f"<dt>{name}<dd>", value) for name, value in facts])
    page = _text('<!doctype html><meta charset="utf-8"><dl>', items, "</dl><pre>", indented_content(), "</pre><main>", F.col("html"), "</main>")
    return blocks.select("operation_id", "block_id", _file_name(".html").alias("file_name"), page.alias("body"))


def block_json_document(blocks: DataFrame) -> DataFrame:
    return blocks.select("operation_id", "block_id", _file_name(".json").alias("file_name"), metadata_json(with_html=True).alias("body"))


# -- summary page -----------------------------------------------------------


def summary_page(operations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Summary page of headers and footers by platform, as chunks ``(operation_id, section, platform, chunk_no, text)``.

    Ordered by those columns they are the page: section 0 is the contents with a count per part and platform, then the headers (1) and
    the footers (2), each platform's frame (chunk 0) before its blocks. The blocks are made once, as a stored table.
    """
    edges = blocks.filter(F.col("block_type").isin("header", "footer")).select("operation_id", "block_id", "block_type", "platform", "block_no", "html", "created_at")
    return summary_rows(operations, stored(edges, "edges"))


def summary_rows(operations: DataFrame, blocks: DataFrame) -> DataFrame:
    """The rows of ``summary_page`` from blocks that are stored already; they are gone through three times."""
    part = F.when(F.col("block_type") == "header", 1).otherwise(2)
    edges = blocks.filter(F.col("block_type").isin("header", "footer")).withColumn("section", part)
    counts = edges.groupBy("operation_id", "section", "platform").agg(F.first("block_type").alias("part"), F.count("*").alias("n"))
    title = _text(F.col("part"), " ", F.col("platform"), " ", F.col("n").cast("string"))
    items = F.sort_array(F.collect_list(F.struct("section", "platform", title.alias("title"))))
    contents = counts.groupBy("operation_id").agg(items.alias("items"))
    listed = F.array_join(F.transform("items", lambda i: F.concat(F.lit("<li>"), i["title"])), "")
    heads = operations.select("operation_id").join(contents, "operation_id", "left").select(
        "operation_id",
        F.lit(0).alias("section"),
        F.lit("").alias("platform"),
        F.lit(0).alias("chunk_no"),
        _text('<!doctype html><meta charset="utf-8"><h1>', F.col("operation_id"), "</h1><ul>", F.coalesce(listed, F.lit("")), "</ul>").alias("text"),
    )
    frames = counts.select("operation_id", "section", "platform", F.lit(0).alias("chunk_no"), _text("<h2>", title, "</h2>").alias("text"))
    body = _text("<section><p>", F.col("block_id"), " ", _seconds("created_at"), "</p>", F.col("html"), "</section>")
    rows = edges.select("operation_id", "section", "platform", F.col("block_no").alias("chunk_no"), body.alias("text"))
    return heads.unionByName(frames).unionByName(rows)


# -- bundle -----------------------------------------------------------------


def bundle_manifest(operations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block file of an operation and the parts of its summary page, with size and checksum. The blocks are made once, as a stored table."""
    blocks = stored(blocks, "blocks")
    chunk = F.format_string("summary_%d_%s_%d.html", "section", "platform", "chunk_no")
    path = F.concat(F.lit("blocks/"), F.col("operation_id"), F.lit("/"), chunk)
    summary = summary_rows(operations, blocks).select("operation_id", path.alias("path"), F.col("text").alias("body"))
    files = artefact_rows(blocks).select("operation_id", "path", "body").unionByName(summary)
    return files.select("operation_id", "path", F.octet_length("body").alias("bytes"), F.sha2("body", 256).alias("sha256"))


def save_blocks(blocks: DataFrame, path: str) -> DataFrame:
    """Write the blocks' files and return the receipt."""
    write_artefacts(blocks, path)
    return saved_blocks(blocks)


def saved_blocks(blocks: DataFrame) -> DataFrame:
    """Receipt of a save: number of blocks and folder of each operation."""
    counts = blocks.groupBy("operation_id").agg(F.count("*").alias("blocks_count"))
    return counts.withColumn("directory", F.concat(F.lit("blocks/"), F.col("operation_id")))
