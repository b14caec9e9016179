"""Tree questions over all pages at once: selectors as structural joins, counts and labels by running sums; links written once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import FACTS, SITE, query, site, table
from pagestrata.operators.dom import node_table, with_nodes
from pagestrata.operators.links import page_links
from pagestrata.operators.structural import block_labels, counts_below, selected
from pagestrata.rules import cls, on, tags
from pagestrata.session import work_dir
from pagestrata.sources.store import write_checked

_SITE = f"WITH {SITE}"
_HEADER = "regexp_extract(html, '(?s)<header[^>]*>(.*?)</header>', 1)"
_FOOTER = "regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)"

SELECTORS = {
    "image in header": [on("img", under=on("header"))],
    "link in footer": [on("a", under=on("footer"))],
    "image of a link": [on("img", child_of=on("a"))],
    "link with image": [on("a", holding=on("img"))],
    "link in list in nav": [on("a", under=on("ul", under=on("nav")))],
    "header with phone or contact": [on("header", holding=on(None, cls("phone"))), on("header", holding=on(None, cls("contact")))],
}


def _count(html: str, part: str) -> str:
    return f"len(regexp_extract_all({html}, '{part}'))"


@query(
    "d2_structural_selectors",
    f"""{_SITE} SELECT * FROM (SELECT page_id, unnest([
      struct_pack(selector := 'image in header', hits := {_count(_HEADER, '<img ')}),
      struct_pack(selector := 'link in footer', hits := {_count(_FOOTER, '<a ')}),
      struct_pack(selector := 'image of a link', hits := {_count('html', '<a [^>]*><img ')}),
      struct_pack(selector := 'link with image', hits := {_count('html', '<a [^>]*><img ')}),
      struct_pack(selector := 'link in list in nav', hits := {_count("regexp_extract(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<ul>(.*?)</ul>', 1)", '<a ')}),
      struct_pack(selector := 'header with phone or contact', hits := CAST(regexp_matches({_HEADER}, 'class="(phone|contact)"') AS BIGINT))
    ], recursive := true) FROM site) WHERE hits > 0""",
)
def d2(spark, sf):
    found = selected(with_nodes(site(spark, sf)), SELECTORS, "page_id")
    return found.groupBy("page_id", "selector").agg(F.count("*").alias("hits"))


@query(
    "d8_nodes_inside",
    f"""{_SITE} SELECT page_id, {_count(_FOOTER, '<li>')} + {_count(_FOOTER, '<p>')} AS inside FROM site
    WHERE {_count(_FOOTER, '<li>')} + {_count(_FOOTER, '<p>')} > 0""",
)
def d8(spark, sf):
    """List items and paragraphs that lie in a page's footer."""
    inside = {"inside": [on("li", under=on("footer")), on("p", under=on("footer"))]}
    return selected(with_nodes(site(spark, sf)), inside, "page_id").groupBy("page_id").agg(F.count("*").alias("inside"))


@query(
    "f7_running_counts",
    f"""{_SITE}, parts AS (SELECT page_id, 'header' AS part, {_HEADER} AS h FROM site WHERE contains(html, '<header')
      UNION ALL SELECT page_id, 'footer', {_FOOTER} FROM site WHERE contains(html, '<footer>'))
    SELECT page_id, part, CAST({_count('h', '<a ')} AS BIGINT) AS links, CAST({_count('h', '<img ')} AS BIGINT) AS images, CAST({_count('h', '<div')} AS BIGINT) AS child_divs FROM parts""",
)
def f7(spark, sf):
    """What lies below each header and footer; their divs are all children."""
    nodes, features = with_nodes(site(spark, sf)), {"links": tags("a"), "images": tags("img")}
    parts = [counts_below(nodes, [on(p)], features, "page_id").withColumn("part", F.lit(p)) for p in ("header", "footer")]
    return parts[0].unionByName(parts[1]).select("page_id", "part", "links", "images", "child_divs")


@query(
    "f3_equal_markup",
    f"""{_SITE}, items AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) AS item FROM site)
    SELECT page_id, count(*) AS items, count(DISTINCT item) AS different FROM items GROUP BY page_id""",
)
def f3(spark, sf):
    """List items of each page, and how many differ in markup, by the digests that the reader makes on its way."""
    nodes = node_table(with_nodes(site(spark, sf), tags=("li",), texts=False), "page_id")
    return nodes.groupBy("page_id").agg(F.count("*").alias("items"), F.count_distinct("digest").alias("different"))


@query("f9_running_labels", f"WITH {SITE}, {FACTS} SELECT page_id, heuristic AS label FROM sections")
def f9(spark, sf):
    nodes = with_nodes(site(spark, sf))
    return block_labels(nodes, "page_id", anchors=[on("section")]).select("page_id", "label")


@query(
    "a10_links_written_once",
    """WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
    marked AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'depth' ELSE 'valid' END AS reason FROM links WHERE href <> '' AND NOT starts_with(href, '#'))
    SELECT reason, count(*) AS links, count(*) AS counted FROM marked GROUP BY reason""",
)
def a10(spark, sf):
    """Links, some without a depth, written by one pass into valid ones and a quarantine; ``counted`` is what that pass saw."""
    depth = F.when(F.col("page_id") % 5 > 0, F.lit(1))
    links = page_links(table(spark, sf, "pages")).select(F.col("page_id").alias("operation_id"), F.col("href").alias("url"), depth.alias("depth"))
    path = f"{work_dir(spark)}/links-{uuid.uuid4().hex}"
    seen = write_checked(links, "links", path)
    seen["valid"] = seen["rows"] - sum(n for name, n in seen.items() if name != "rows")
    counted = F.create_map(*[F.lit(v) for pair in seen.items() for v in pair])
    reason = F.coalesce("reason", F.lit("valid"))
    return spark.read.parquet(path).groupBy(reason.alias("reason")).agg(F.count("*").alias("links")).withColumn("counted", counted[F.col("reason")])
