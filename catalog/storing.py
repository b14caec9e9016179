"""Stored tables: operations, status, artefacts, constraints, lookups, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import OPS, SITE, STATUS, TEMPLATES, at, over_blocks, query, site, site_blocks, site_operations, sql_string, status_log, table
from pagestrata.operators.links import page_links
from pagestrata.operators.templates import template_match, template_table, templates_of
from pagestrata.plans import reports
from pagestrata.plans.parse import operations
from pagestrata.sources import store
from pagestrata.session import work_dir
from pagestrata.streaming.ingest import ingest, page_stream
from pagestrata.streaming.status import running_status

_OPS = f"WITH {SITE}, {OPS}"
_Z = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"


@query("a4_operations", f"{_OPS} SELECT operation_id, url, 'pending' AS status, created_at, created_at AS updated_at FROM ops")
def a4(spark, sf):
    return operations(site(spark, sf), at("page_id"), at("page_id"))


_LATEST = f"WITH {STATUS} SELECT operation_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at FROM status_log GROUP BY operation_id"


@query("a5_current_status", _LATEST)
def a5(spark, sf):
    return store.current_status(status_log(spark, sf))


@query("j2_running_status", _LATEST)
def j2(spark, sf):
    return running_status(status_log(spark, sf))


@query(
    "j2_status_steps",
    f"""WITH {STATUS}, steps AS (SELECT operation_id, event_id, lag(status) OVER (PARTITION BY operation_id ORDER BY ts, event_id) AS before, status FROM status_log)
    SELECT operation_id, event_id, before, status, coalesce((before IS NULL AND status = 'pending') OR before = status
      OR (before = 'pending' AND status = 'processing') OR (before = 'processing' AND status IN ('completed', 'error')), false) AS allowed FROM steps""",
)
def j2_steps(spark, sf):
    return store.status_steps(status_log(spark, sf)).drop("ts")


@query("a6_block_partitions", over_blocks("SELECT platform, block_type, count(*) AS blocks, sum(strlen(html))::BIGINT AS bytes FROM blocks GROUP BY platform, block_type"))
def a6(spark, sf):
    blocks = site_blocks(spark, sf)
    return blocks.groupBy("platform", "block_type").agg(F.count("*").alias("blocks"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))


_PATH = "'blocks/' || operation_id || '/' || block_type || '_' || block_id"


@query(
    "a7_artefacts",
    over_blocks(f"""SELECT operation_id, block_id, {_PATH} || '.html' AS path, 'html' AS kind, md5(html) AS checksum FROM blocks
      UNION ALL SELECT operation_id, block_id, {_PATH} || '_metadata.json', 'metadata', NULL FROM blocks"""),
)
def a7(spark, sf):
    files = store.artefact_rows(site_blocks(spark, sf))
    return files.select("operation_id", "block_id", "path", "kind", F.when(F.col("kind") == "html", F.md5("body")).alias("checksum"))


_LINKS = """links AS (SELECT * FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages)
  WHERE href <> '' AND NOT starts_with(href, '#'))"""


@query("a8_new_links", f"WITH {_LINKS} SELECT DISTINCT CAST(page_id AS VARCHAR) AS operation_id, href AS url FROM links WHERE page_id % 2 = 1 OR href <> '/the'")
def a8(spark, sf):
    links = page_links(table(spark, sf, "pages")).select(F.col("page_id").cast("string").alias("operation_id"), F.col("href").alias("url"))
    before = links.filter("operation_id % 2 = 0 AND url = '/the'")
    return store.new_links(links, before)


_TEMPLATES = "VALUES " + ", ".join(f"({number}, {priority}, {sql_string(label)})" for number, priority, label, _ in TEMPLATES)


@query(
    "a9_template_hits",
    over_blocks(f"""SELECT t.template_id, t.label, count(k.page_id) AS blocks FROM ({_TEMPLATES}) t(template_id, priority, label)
      LEFT JOIN kept k USING (template_id) GROUP BY t.template_id, t.label"""),
)
def a9(spark, sf):
    blocks = site_blocks(spark, sf).filter("block_type = 'content'").select(template_match("html", value="id").alias("template_id"))
    found = blocks.groupBy("template_id").agg(F.count("*").alias("n"))
    joined = template_table(spark).select("template_id", "label").join(found, "template_id", "left")
    return joined.select("template_id", "label", F.coalesce("n", F.lit(0)).alias("blocks"))


@query(
    "b6_templates_in_order",
    over_blocks(f"""SELECT t.priority, t.template_id, count(k.page_id) AS blocks FROM ({_TEMPLATES}) t(template_id, priority, label)
      LEFT JOIN kept k USING (template_id) GROUP BY t.priority, t.template_id"""),
)
def b6(spark, sf):
    blocks = site_blocks(spark, sf).filter("block_type = 'content'").select(template_match("html", value="id").alias("template_id"))
    rules = templates_of(template_table(spark), "html5")
    found = rules.join(blocks.groupBy("template_id").agg(F.count("*").alias("n")), "template_id", "left")
    return found.select("priority", "template_id", F.coalesce("n", F.lit(0)).alias("blocks"))


@query(
    "a10_constraints",
    over_blocks("""SELECT CASE WHEN position % 3 = 1 THEN 'block_type' WHEN platform = 'tilda' THEN 'platform' ELSE 'valid' END AS reason, count(*) AS blocks
      FROM blocks GROUP BY 1"""),
)
def a10(spark, sf):
    """Blocks, some with a type or platform that is not allowed, by the constraint they break."""
    blocks = site_blocks(spark, sf)
    kind = F.when(F.col("position") % 3 == 1, F.lit("aside")).otherwise(F.col("block_type"))
    builder = F.when(F.col("platform") == "tilda", F.lit("other")).otherwise(F.col("platform"))
    marked = blocks.withColumns({"block_type": kind, "platform": builder})
    return marked.groupBy(F.coalesce(store.violation("blocks"), F.lit("valid")).alias("reason")).agg(F.count("*").alias("blocks"))


@query(
    "a10_link_quarantine",
    f"""WITH {_LINKS}, marked AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'depth' ELSE 'valid' END AS reason FROM links)
    SELECT reason, count(*) AS links FROM marked GROUP BY reason""",
)
def a10_links(spark, sf):
    """Links, some without a depth, split into valid ones and a quarantine."""
    rows = page_links(table(spark, sf, "pages"))
    depth = F.when(F.col("page_id") % 5 > 0, F.lit(1))
    links = rows.select(F.col("page_id").alias("operation_id"), F.col("href").alias("url"), depth.alias("depth"))
    valid, quarantine = store.split_valid(links, "links")
    both = valid.select(F.lit("valid").alias("reason")).unionByName(quarantine.select("reason"))
    return both.groupBy("reason").agg(F.count("*").alias("links"))


@query("a11_cascade", over_blocks("SELECT block_id FROM blocks WHERE page_id % 3 <> 0"))
def a11(spark, sf):
    deleted = operations(site(spark, sf).filter("page_id % 3 = 0"), at("page_id"), at("page_id"))
    return store.without_operations(site_blocks(spark, sf), deleted).select("block_id")


@query("a11_orphans", over_blocks("SELECT block_id FROM blocks WHERE page_id % 5 = 0"))
def a11_orphans(spark, sf):
    left = operations(site(spark, sf).filter("page_id % 5 <> 0"), at("page_id"), at("page_id"))
    return store.orphans(site_blocks(spark, sf), left).select("block_id")


# The operation that lookups of one operation ask for: the least id.


def _least(spark, sf):
    return site_operations(spark, sf).agg(F.min("operation_id")).first()[0]


_OF_LEAST = "WHERE operation_id = (SELECT min(operation_id) FROM ops)"


@query("b1_operation", f"{_OPS} SELECT operation_id, url, status, created_at, updated_at FROM ops {_OF_LEAST}")
def b1(spark, sf):
    return store.operation_by_id(site_operations(spark, sf), _least(spark, sf))


@query("b2_newest_operations", f"{_OPS} SELECT operation_id, url, created_at FROM ops ORDER BY created_at DESC, operation_id")
def b2(spark, sf):
    return store.newest_operations(site_operations(spark, sf)).select("operation_id", "url", "created_at")


@query("b3_blocks_of_operation", over_blocks(f"SELECT block_id, position, block_type FROM blocks {_OF_LEAST}"))
def b3(spark, sf):
    return store.blocks_of(site_blocks(spark, sf), _least(spark, sf)).select("block_id", "position", "block_type")


@query("b4_block", over_blocks("SELECT block_id, operation_id, block_type FROM blocks WHERE block_id = (SELECT md5(min(operation_id) || '|9') FROM ops) OR block_id = (SELECT min(block_id) FROM blocks)"))
def b4(spark, sf):
    blocks = site_blocks(spark, sf)
    return store.block_by_id(blocks, blocks.agg(F.min("block_id")).first()[0]).select("block_id", "operation_id", "block_type")


@query("b5_links_of_operation", f"WITH {_LINKS} SELECT CAST(page_id AS VARCHAR) AS operation_id, href AS url, 1 AS depth FROM links WHERE page_id = 7")
def b5(spark, sf):
    links = page_links(table(spark, sf, "pages")).select(F.col("page_id").cast("string").alias("operation_id"), F.col("href").alias("url"), F.lit(1).alias("depth"), F.lit(0).alias("created_at"))
    return store.links_of(links, "7").drop("created_at")


@query("b7_operation_results", over_blocks("SELECT o.operation_id, o.url, o.status, block_id, block_type, block_no, content FROM ops o LEFT JOIN blocks b USING (operation_id)"))
def b7(spark, sf):
    return store.operation_results(site_operations(spark, sf), site_blocks(spark, sf))


@query("b8_owned_blocks", over_blocks("SELECT operation_id, block_id FROM blocks WHERE position % 2 = 0"))
def b8(spark, sf):
    blocks = site_blocks(spark, sf)
    claims = blocks.select(F.when(F.col("position") % 2 == 0, F.col("operation_id")).otherwise("none").alias("operation_id"), "block_id")
    return store.owned_blocks(blocks, claims)


@query(
    "b9_file_listing",
    over_blocks("""SELECT operation_id, k.kind, block_type || '_' || block_id || k.ending AS file, n AS html_files, n AS metadata_files, 2 * n AS total
      FROM blocks JOIN (SELECT operation_id, count(*) AS n FROM blocks GROUP BY operation_id) USING (operation_id),
        (VALUES ('html', '.html'), ('metadata', '_metadata.json')) k(kind, ending)"""),
)
def b9(spark, sf):
    return store.file_listing(store.artefact_rows(site_blocks(spark, sf)))


@query("b10_artefact_body", over_blocks(f"SELECT operation_id, block_id, 'html' AS kind, {_PATH} || '.html' AS path, html AS body FROM blocks WHERE block_type = 'header' AND html <> ''"))
def b10(spark, sf):
    blocks = site_blocks(spark, sf)
    wanted = blocks.filter("block_type = 'header'").select("operation_id", "block_id", F.lit("html").alias("kind"))
    return store.artefact_body(store.artefact_rows(blocks), wanted)


# -- reports ----------------------------------------------------------------


@query("h1_operation_sheet", f"{_OPS} SELECT operation_id, url, status, {_Z.format('created_at')} AS created_at, {_Z.format('updated_at')} AS updated_at FROM ops")
def h1(spark, sf):
    return reports.operation_sheet(site_operations(spark, sf))


_SAFE = "replace(replace(replace(content, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')"


# The most characters that fit into 32,767 bytes, and the mark of a cut (a fixed value).
_CUT = """left(html, list_max(list_filter(range(8191, 32768), lambda k: strlen(left(html, k)) <= 32767))) || '...' || chr(10) || '[Превышен лимит символов Excel]'"""


@query(
    "h2_block_sheet",
    over_blocks(f"SELECT operation_id, block_id, block_type, platform, {_Z.format('created_at')} AS created_at, {_SAFE} AS content, CASE WHEN strlen(html) <= 32767 THEN html ELSE {_CUT} END AS html_preview FROM blocks"),
)
def h2(spark, sf):
    return reports.block_sheet(site_blocks(spark, sf))


@query(
    "h3_short_block_sheet",
    over_blocks(f"""SELECT operation_id, block_id, block_type, platform, {_Z.format('created_at')} AS created_at,
      coalesce(json_extract_string(content, '$.template_name'), 'N/A') AS template_name, content AS components FROM blocks"""),
)
def h3(spark, sf):
    return reports.short_block_sheet(site_blocks(spark, sf))


_STATISTICS = """SELECT operation_id, CASE WHEN grouping(block_type) = 0 THEN 'type' WHEN grouping(platform) = 0 THEN 'platform' ELSE 'total' END AS section,
  CASE WHEN grouping(block_type) = 0 THEN block_type WHEN grouping(platform) = 0 THEN platform END AS name, count(*) AS blocks
  FROM blocks GROUP BY GROUPING SETS ((operation_id, block_type), (operation_id, platform), (operation_id))"""


@query("h6_statistics", over_blocks(_STATISTICS))
def h6(spark, sf):
    return reports.statistics(site_blocks(spark, sf))


@query("h4_by_type", over_blocks("SELECT operation_id, block_type AS name, count(*) AS blocks FROM blocks GROUP BY operation_id, block_type"))
def h4(spark, sf):
    return reports.statistics(site_blocks(spark, sf)).filter("section = 'type'").drop("section")


@query("h5_by_platform", over_blocks("SELECT operation_id, platform AS name, count(*) AS blocks FROM blocks GROUP BY operation_id, platform"))
def h5(spark, sf):
    return reports.statistics(site_blocks(spark, sf)).filter("section = 'platform'").drop("section")


@query("h7_text_report")
def h7(spark, sf):
    return reports.text_report(site_operations(spark, sf), site_blocks(spark, sf))


@query(
    "h8_short_text_report",
    over_blocks(f"""SELECT operation_id, 0 AS chunk_no, concat_ws(chr(10), operation_id, url, status, {_Z.format('created_at')}, {_Z.format('updated_at')}, '') AS text FROM ops
      UNION ALL SELECT operation_id, block_no, concat_ws(chr(10), block_id, block_type, platform, {_Z.format('created_at')}, html, '') FROM blocks"""),
)
def h8(spark, sf):
    return reports.short_text_report(site_operations(spark, sf), site_blocks(spark, sf))


@query(
    "h9_summary_page",
    over_blocks("""SELECT operation_id, section, platform, 0 AS chunk_no, '<h2>' || title || '</h2>' AS text FROM (
        SELECT operation_id, CASE block_type WHEN 'header' THEN 1 ELSE 2 END AS section, platform, block_type || ' ' || platform || ' ' || count(*) AS title
        FROM blocks WHERE block_type <> 'content' GROUP BY operation_id, block_type, platform)
      UNION ALL SELECT operation_id, CASE block_type WHEN 'header' THEN 1 ELSE 2 END, platform, block_no,
        '<section><p>' || block_id || ' ' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '</p>' || html || '</section>' FROM blocks WHERE block_type <> 'content'
      UNION ALL SELECT o.operation_id, 0, '', 0, '<!doctype html><meta charset="utf-8"><h1>' || o.operation_id || '</h1><ul>' || coalesce(items, '') || '</ul>'
      FROM ops o LEFT JOIN (
        SELECT operation_id, string_agg('<li>' || title, '' ORDER BY section, platform) AS items FROM (
          SELECT operation_id, CASE block_type WHEN 'header' THEN 1 ELSE 2 END AS section, platform, block_type || ' ' || platform || ' ' || count(*) AS title
          FROM blocks WHERE block_type <> 'content' GROUP BY operation_id, block_type, platform) GROUP BY operation_id) USING (operation_id)"""),
)
def h9(spark, sf):
    return reports.summary_page(site_operations(spark, sf), site_blocks(spark, sf))


@query("h10_block_html")
def h10(spark, sf):
    return reports.block_html_document(site_blocks(spark, sf))


@query("h11_block_json")
def h11(spark, sf):
    return reports.block_json_document(site_blocks(spark, sf))


@query("h12_bundle_manifest")
def h12(spark, sf):
    return reports.bundle_manifest(site_operations(spark, sf), site_blocks(spark, sf))


@query("j4_saved_blocks", over_blocks("SELECT operation_id, count(*) AS blocks_count, 'blocks/' || operation_id AS directory FROM blocks GROUP BY operation_id"))
def j4(spark, sf):
    return reports.saved_blocks(site_blocks(spark, sf))


@query("j3_streamed_blocks", "SELECT 'html5' AS platform, 'footer' AS block_type, count(*) AS blocks FROM pages")
def j3(spark, sf):
    """Blocks of the pages as a stream of files, appended to a table and read again."""
    out = f"{work_dir(spark)}/streamed-{uuid.uuid4().hex}"
    ingest(page_stream(spark, f"{sf}/page[s].parquet"), f"{out}/blocks", f"{out}/log", at("page_id")).awaitTermination()
    return spark.read.parquet(f"{out}/blocks").groupBy("platform", "block_type").agg(F.count("*").alias("blocks"))
