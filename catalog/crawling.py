"""Links, their resolution and normal form, traversal, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import CRAWL, crawl_pages, pages, query, table
from pagestrata.functions.urls import domain_key, in_domains, normal_url
from pagestrata.operators.links import allowed_by_table, page_links, seeds_with_defaults
from pagestrata.plans.crawl import crawl, crawl_report, fetch_schedule

_PLAIN = """raw AS (SELECT page_id, url, html, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS found FROM pages),
  hrefs AS (SELECT page_id, url, u.href, u.n FROM raw, LATERAL (SELECT unnest(list_filter(found, lambda h: h <> '' AND NOT starts_with(h, '#'))) AS href,
    generate_subscripts(list_filter(found, lambda h: h <> '' AND NOT starts_with(h, '#')), 1) AS n) u)"""


def _crawl_views() -> str:
    """CRAWL as a list of views whose last is crawl_pages."""
    head, _, tail = CRAWL.partition("SELECT id AS page_id")
    return f"{head.rstrip()}, crawl_pages AS (SELECT id AS page_id{tail})"


_VIEWS = _crawl_views()


@query("g1_links", f"WITH {_PLAIN} SELECT page_id, href, n - 1 AS link_no FROM hrefs")
def g1(spark, sf):
    return page_links(pages(spark, sf)).select("page_id", "href", F.col("link_no").cast("long").alias("link_no"))


@query("g2_resolved_links", f"WITH {_PLAIN} SELECT page_id, href, regexp_extract(url, '^(https?://[^/?#]*)', 1) || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS link FROM hrefs")
def g2(spark, sf):
    return page_links(pages(spark, sf)).select("page_id", "href", "link")


@query("g3_normal_urls", "SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?]+)/(\\?.*)?$', '\\1\\2') AS url FROM pages")
def g3(spark, sf):
    return pages(spark, sf).select("page_id", normal_url(F.col("url")).alias("url"))


_HOST = "regexp_extract(url, '^https?://([^/:?#]*)', 1)"


@query("g4_allowed_urls", f"SELECT page_id, {_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com' AS allowed FROM pages")
def g4(spark, sf):
    return pages(spark, sf).select("page_id", in_domains(F.col("url"), ["example.com"]).alias("allowed"))


@query("g4_allowed_by_table", f"SELECT page_id FROM pages WHERE {_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com'")
def g4_table(spark, sf):
    domains = pages(spark, sf).select(F.lit("example.com").alias("domain")).distinct()
    return allowed_by_table(pages(spark, sf).select("page_id", "url"), "url", domains).select("page_id")


@query("g8_domain_keys", f"SELECT {_HOST} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def g8(spark, sf):
    return pages(spark, sf).groupBy(domain_key(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


_DEPTH = 4
_BFS = f"""WITH RECURSIVE {_VIEWS}, edges AS (
    SELECT url, target FROM (
      SELECT url, unnest([regexp_replace(x, '[?#].*$', '') FOR x IN regexp_extract_all(html, '<a href="([^"]+)"', 1) IF starts_with(x, 'http')]) AS target
      FROM crawl_pages WHERE status = 200)
    WHERE target LIKE '%.example.com/%'
  ), seeds AS (SELECT url AS seed_url FROM crawl_pages WHERE page_id % 50 = 0 AND url LIKE '%.example.com/%'
  ), walk(seed_url, url, depth) AS (
    SELECT seed_url, seed_url, 0 FROM seeds
    UNION
    SELECT w.seed_url, e.target, w.depth + 1 FROM walk w JOIN edges e USING (url) WHERE w.depth < {_DEPTH}
  ), visited AS (
    SELECT w.seed_url, w.url, min(w.depth) AS depth, any_value(p.status) AS status FROM walk w LEFT JOIN crawl_pages p USING (url) GROUP BY w.seed_url, w.url
  )"""


def _visited(spark, sf):
    rows = crawl_pages(spark, sf)
    seeds = rows.filter("page_id % 50 = 0").select(F.col("url").alias("seed_url"), F.lit(_DEPTH).alias("max_depth"))
    return crawl(rows, seeds, ["example.com"])


@query("g6_crawl", f"{_BFS} SELECT seed_url, url, depth, status FROM visited")
def g6(spark, sf):
    return _visited(spark, sf)


@query("g7_expanded_pages", f"{_BFS} SELECT depth, count(*) AS pages FROM visited WHERE status = 200 GROUP BY depth")
def g7(spark, sf):
    return _visited(spark, sf).filter("status = 200").groupBy("depth").agg(F.count("*").alias("pages"))


@query(
    "g10_crawl_report",
    f"{_BFS} SELECT seed_url, url, depth, count(*) OVER (PARTITION BY seed_url) AS links_count FROM visited WHERE status = 200",
)
def g10(spark, sf):
    return crawl_report(_visited(spark, sf))


@query(
    "g9_fetch_schedule",
    f"""SELECT url, domain, slot, slot AS start_seconds FROM (
      SELECT *, row_number() OVER (PARTITION BY domain ORDER BY depth, substring(md5(url), 1, 3), url) - 1 AS slot
      FROM (SELECT DISTINCT url, {_HOST} AS domain, CAST(page_id % 3 AS INTEGER) AS depth FROM pages))""",
)
def g9(spark, sf):
    urls = pages(spark, sf).select("url", (F.col("page_id") % 3).cast("int").alias("depth")).distinct()
    return fetch_schedule(urls).select("url", "domain", "slot", "start_seconds")


@query(
    "g11_effective_parameters",
    """SELECT url AS seed_url, CASE WHEN page_id % 4 > 0 THEN page_id % 4 ELSE 2 END AS max_depth, CASE WHEN page_id % 3 - 1 > 0 THEN page_id % 3 - 1 ELSE 5 END AS concurrency
    FROM pages""",
)
def g11(spark, sf):
    asked = table(spark, sf, "pages").select(
        F.col("url").alias("seed_url"), F.when(F.col("page_id") % 4 > 0, F.col("page_id") % 4).alias("max_depth"), (F.col("page_id") % 3 - 1).alias("concurrency")
    )
    return seeds_with_defaults(asked, 2, 5)
