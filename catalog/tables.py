"""Rules, files and stored tables as tables: templates and markers by join, files with names of their own."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from catalog.base import MARKERS, ORACLES, SITE, STATUS, at, over_blocks, pages, query, site, site_blocks, site_operations, sql_string, status_log
from pagestrata.operators import patterns
from pagestrata.operators.links import page_links
from pagestrata.operators.templates import template_table
from pagestrata.plans.parse import page_blocks
from pagestrata.rules import MARKERS as MARKER_RULES
from pagestrata.session import work_dir
from pagestrata.sources import files
from pagestrata.sources.pages import read_page_files
from pagestrata.sources.site_store import SiteStore
from pagestrata.streaming import flow, ingest

_MARKER_ROWS = ", ".join(f"({sql_string(p)}, {sql_string(m)})" for p, markers in MARKERS.items() for m in markers)


@query(
    "c7_marker_table",
    f"""WITH {SITE}, markers(platform, marker) AS (VALUES {_MARKER_ROWS})
    SELECT page_id, platform, marker FROM site, markers WHERE contains(html, marker)""",
)
def c7_table(spark, sf):
    """Markers given as a table, found through an index of their grams."""
    markers = spark.createDataFrame([(p, m) for p, found in MARKER_RULES.items() for m in found], "platform string, marker string")
    return patterns.marker_table_hits(site(spark, sf), markers)


@query("f6_template_table", over_blocks("SELECT block_id, k.template_id, k.template AS label FROM blocks JOIN kept k USING (page_id) WHERE block_type = 'content' AND k.template_id IS NOT NULL"))
def f6_table(spark, sf):
    """First template of each content block, templates read from their table."""
    blocks = page_blocks(site(spark, sf), at("page_id + 1"), templates=()).where("block_type = 'content'")
    return patterns.first_templates(blocks, patterns.template_steps(template_table(spark)))


@query(
    "f13_labels_by_table",
    over_blocks("SELECT block_id, json_extract_string(content, '$.matched_pattern') AS matched_pattern, json_extract_string(content, '$.template_name') AS template_name FROM blocks WHERE block_type = 'content'"),
)
def f13_table(spark, sf):
    """Labels where templates come from a table and only the others are labelled by heuristics."""
    blocks = page_blocks(site(spark, sf), at("page_id + 1"), templates=())
    named = patterns.relabelled(blocks, patterns.template_steps(template_table(spark))).where("block_type = 'content'")
    return named.select("block_id", *(F.get_json_object("content", f"$.{k}").alias(k) for k in ("matched_pattern", "template_name")))


# -- files -------------------------------------------------------------------------


def _folder(spark) -> str:
    return f"{work_dir(spark)}/files-{uuid.uuid4().hex}"


_KEY = "translate(regexp_replace(regexp_replace(url, '^http://', ''), '^https://', ''), '/\\:*?\"<>|', '_________')"


@query("a2_page_files_written", f"SELECT {_KEY} || '.' || CAST(page_id AS VARCHAR) || '.html' AS path, CAST(strlen(html) AS BIGINT) AS bytes, md5(html) AS checksum FROM pages")
def a2_written(spark, sf):
    """One file per page, written by tasks, published together, and read again."""
    folder = _folder(spark)
    files.write_page_files(pages(spark, sf), folder)
    return files.read_files(spark, folder).select("path", "bytes", F.md5("body").alias("checksum"))


@query("a1_saved_page_files", f"SELECT {_KEY} || '.' || CAST(page_id AS VARCHAR) || '.html' AS name, md5(html) AS checksum FROM pages")
def a1_saved(spark, sf):
    """Saved page files as a source of pages."""
    folder = _folder(spark)
    files.write_page_files(pages(spark, sf), folder)
    return read_page_files(spark, folder).select(F.element_at(F.split("url", "/"), -1).alias("name"), F.md5("html").alias("checksum"))


_PATH = "'blocks/' || operation_id || '/' || block_type || '_' || block_id"
_CREATED = "strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')"


@query(
    "a7_block_files_written",
    over_blocks(f"""SELECT {_PATH} || '.html' AS path, md5(html) AS checksum, NULL AS id, NULL AS operation_id, NULL AS block_type, NULL AS platform, NULL AS created_at, NULL AS template_name, NULL AS version FROM blocks
      UNION ALL SELECT {_PATH} || '_metadata.json', NULL, block_id, operation_id, block_type, platform, {_CREATED}, json_extract_string(content, '$.template_name'),
        json_extract_string(content, '$.version') FROM blocks"""),
)
def a7_written(spark, sf):
    """Both files of every block as read from disk: the markup's checksum, the facts in the metadata."""
    folder = _folder(spark)
    files.save_block_files(site_blocks(spark, sf), folder)
    found = files.read_files(spark, folder)
    is_html = F.endswith("path", F.lit(".html"))
    paths = {**{k: k for k in ("id", "operation_id", "block_type", "platform", "created_at")}, "template_name": "content.template_name", "version": "content.version"}
    facts = [F.when(~is_html, F.get_json_object("body", f"$.{path}")).alias(name) for name, path in paths.items()]
    return found.select("path", F.when(is_html, F.md5("body")).alias("checksum"), *facts)


@query(
    "h12_bundles_written",
    f"""WITH page AS ({ORACLES['h9_summary_page']}), {over_blocks('').strip().removeprefix('WITH')}
      SELECT 'blocks/' || operation_id || '/blocks_summary.html' AS path, md5(string_agg(text, '' ORDER BY section, platform, chunk_no)) AS checksum, count(*) - count(*) AS other_files
      FROM page GROUP BY operation_id
      UNION ALL SELECT 'blocks/' || operation_id, NULL, 2 * count(*) FROM blocks GROUP BY operation_id""",
)
def h12_written(spark, sf):
    """Every operation's folder on disk: the checksum of its summary document, the number of its other files."""
    folder = _folder(spark)
    files.write_bundles(site_operations(spark, sf), site_blocks(spark, sf), folder)
    found = files.read_files(spark, folder)
    is_summary = F.endswith("path", F.lit("/blocks_summary.html"))
    path = F.when(is_summary, F.col("path")).otherwise(F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    checksum = F.when(is_summary, F.md5("body"))
    return found.select(path.alias("path"), checksum.alias("checksum"), is_summary.alias("s")).groupBy("path", "checksum").agg(F.count_if(~F.col("s")).alias("other_files"))


# -- streams -----------------------------------------------------------------------


@query(
    "j3_ingested_tables",
    over_blocks("""SELECT 'blocks' AS table_name, platform AS name, block_type AS kind, count(*) AS n FROM blocks GROUP BY platform, block_type
      UNION ALL SELECT 'artefacts', platform, kind, count(*) FROM blocks, (VALUES ('html'), ('metadata')) k(kind) GROUP BY platform, kind
      UNION ALL SELECT 'operations', platform, 'completed', count(*) FROM facts GROUP BY platform"""),
)
def j3_tables(spark, sf):
    """All tables of the site pages as a stream ingested in one reading: rows by platform and kind."""
    out = _folder(spark)
    site(spark, sf).write.parquet(f"{out}/pages")
    stream = ingest.page_stream(spark, f"{out}/pages", max_files=4)
    ingest.ingest_tables(stream, f"{out}/site", f"{out}/log", at("page_id + 1")).awaitTermination()
    operations, blocks, artefacts = (ingest.stored_table(spark, f"{out}/site", t) for t in ("operations", "blocks", "artefacts"))
    kinds = artefacts.join(blocks.select("block_id", "platform"), "block_id")
    rows = [("blocks", blocks, "block_type"), ("artefacts", kinds, "kind"), ("operations", operations, "status")]
    made = [r.groupBy(F.col("platform").alias("name"), F.col(k).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "name", "kind", "n") for t, r, k in rows]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(
    "j1_ingested_links",
    f"""WITH {SITE}, hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM site WHERE page_id % 6 = 4)
    SELECT DISTINCT md5(url || '|' || CAST(page_id AS VARCHAR)) AS operation_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS link
    FROM hrefs WHERE href <> '' AND NOT starts_with(href, '#')""",
)
def j1_links(spark, sf):
    """Links that ingest stores, each address once per operation, of pages of an unknown platform too."""
    out = _folder(spark)
    some = site(spark, sf).where("page_id % 6 = 4")
    ingest.store_batch(some, 0, out, at("page_id + 1"))
    return ingest.stored_table(spark, out, "links").select("operation_id", F.col("url").alias("link"))


_STEPS = f"""WITH {STATUS}, steps AS (SELECT operation_id, event_id, ts, lag(status) OVER w AS before, lead(ts) OVER w AS next, status
      FROM status_log WINDOW w AS (PARTITION BY operation_id ORDER BY ts, event_id))"""


@query(
    "j2_status_flow",
    f"""{_STEPS} SELECT operation_id, 'step' AS kind, event_id, before, status, coalesce((before IS NULL AND status = 'pending') OR before = status
      OR (before = 'pending' AND status = 'processing') OR (before = 'processing' AND status IN ('completed', 'error')), false) AS allowed FROM steps
    UNION ALL SELECT operation_id, 'timeout', NULL, status, 'error', false FROM steps
      WHERE status IN ('pending', 'processing') AND (next IS NULL OR next > ts + INTERVAL 12 HOUR)""",
)
def j2_flow(spark, sf):
    """Steps and time-outs of the status log as a stream, in files by time and a last event that lets time pass."""
    out = _folder(spark)
    log = status_log(spark, sf)
    end = log.agg(F.max("ts") + F.expr("INTERVAL 400 DAYS")).first()[0]
    log.repartitionByRange(4, "ts").write.parquet(f"{out}/events")
    last = spark.createDataFrame([(None, end, -1, "pending")], log.schema)
    last.coalesce(1).write.mode("append").parquet(f"{out}/events")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 5).parquet(f"{out}/events")
    found = flow.status_flow(stream, delay=timedelta(days=40), limit=timedelta(hours=12), retention=timedelta(days=300))
    found.writeStream.format("parquet").option("checkpointLocation", f"{out}/log").option("path", f"{out}/flow").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{out}/flow")
    return rows.where("operation_id IS NOT NULL").select("operation_id", "kind", "event_id", "before", "status", "allowed")


# -- stored tables -------------------------------------------------------------------


def _site_store(spark, sf, *names: str) -> SiteStore:
    store = SiteStore(spark, _folder(spark), 8)
    for name in names:
        store.add(name, site_operations(spark, sf) if name == "operations" else site_blocks(spark, sf))
    return store


_OF_LEAST = "WHERE operation_id = (SELECT min(operation_id) FROM ops)"


@query("b3_stored_blocks", over_blocks(f"SELECT block_id, position, block_type, md5(html) AS checksum, status FROM blocks JOIN ops USING (operation_id) {_OF_LEAST}"))
def b3_stored(spark, sf):
    """Blocks of one operation with its status, each read from one shard of a stored table."""
    store = _site_store(spark, sf, "operations", "blocks")
    least = store.table("operations").agg(F.min("operation_id")).first()[0]
    blocks, operation = store.of("blocks", least), store.of("operations", least)
    return blocks.join(operation.select("operation_id", "status"), "operation_id").select("block_id", "position", "block_type", F.md5("html").alias("checksum"), "status")


@query("b4_stored_block", over_blocks("SELECT operation_id, block_id, platform, block_type, position, content FROM blocks WHERE block_id = (SELECT min(block_id) FROM blocks)"))
def b4_stored(spark, sf):
    """One block of a stored table by its id."""
    store = _site_store(spark, sf, "blocks")
    least = store.table("blocks").agg(F.min("block_id")).first()[0]
    return store.block(least).select("operation_id", "block_id", "platform", "block_type", "position", "content")


@query(
    "a8_stored_links",
    """WITH hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages)
    SELECT CAST(page_id AS VARCHAR) AS operation_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS url,
      min(CASE WHEN page_id % 2 = 0 AND contains(href, 'e') THEN 2 ELSE 1 END) AS depth
    FROM hrefs WHERE href <> '' AND NOT starts_with(href, '#') GROUP BY ALL""",
)
def a8_stored(spark, sf):
    """Links of all pages, some of them stored before with another depth, which stays."""
    store = SiteStore(spark, _folder(spark), 8)
    found = page_links(pages(spark, sf)).where("link IS NOT NULL")
    links = found.select(F.col("page_id").cast("string").alias("operation_id"), F.col("link").alias("url"), "href", F.current_timestamp().alias("created_at"))
    store.add("links", links.where("operation_id % 2 = 0 AND contains(href, 'e')").select("operation_id", "url", F.lit(2).alias("depth"), "created_at"))
    store.add("links", links.select("operation_id", "url", F.lit(1).alias("depth"), "created_at"))
    return store.table("links").select("operation_id", "url", "depth")


@query(
    "a11_stored_cascade",
    over_blocks("""SELECT 'operations' AS table_name, operation_id, NULL AS block_id FROM ops WHERE page_id % 3 <> 0
      UNION ALL SELECT 'blocks', operation_id, block_id FROM blocks WHERE page_id % 3 <> 0"""),
)
def a11_stored(spark, sf):
    """What is left of operations and blocks when a third of the operations is deleted."""
    store = _site_store(spark, sf, "operations", "blocks")
    gone = site(spark, sf).where("page_id % 3 = 0").select(F.md5(F.concat_ws("|", "url", F.col("page_id").cast("string"))).alias("operation_id"))
    store.delete(gone)
    rows = [store.table(n).select(F.lit(n).alias("table_name"), "operation_id", c.cast("string").alias("block_id")) for n, c in (("operations", F.lit(None)), ("blocks", F.col("block_id")))]
    return rows[0].unionByName(rows[1])
