"""Parsed pages: containers, fields, content blocks, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import FACTS, SITE, at, over_blocks, query, site, site_blocks
from pagestrata.operators.detect import platform
from pagestrata.operators.dom import sql_below, sql_inner_html, with_nodes
from pagestrata.operators.segments import sql_candidates, sql_features, with_measured
from pagestrata.plans.parse import outcomes, with_page_blocks
from pagestrata.rules import MARKERS, PLATFORMS, OwnPlatform, cls, on

_J1 = ("operation_id", "block_id", "block_type", "platform", "position", "block_no", "content", "html", "created_at")


@query("j1_page_blocks", over_blocks(f"SELECT {', '.join(_J1)} FROM blocks"))
def j1(spark, sf):
    return site_blocks(spark, sf).select(*_J1)


def _part(name: str, builder: str, kind: str, *keys: str) -> None:
    """Register a query for one part of one site builder: its markup, or fields of its content."""
    if keys:
        columns = ", ".join(f"json_extract_string(content, '$.{k}') AS {k}" for k in keys)
    else:
        columns = "html"
    sql = over_blocks(f"SELECT operation_id, {columns} FROM blocks WHERE platform = '{builder}' AND block_type = '{kind}'")

    def run(spark, sf):
        found = site_blocks(spark, sf).filter((F.col("platform") == builder) & (F.col("block_type") == kind))
        columns = [F.get_json_object("content", f"$.{k}").alias(k) for k in keys] or ["html"]
        return found.select("operation_id", *columns)

    query(name, sql)(run)


_part("e1_html5_header", "html5", "header")
_part("e2_html5_header_fields", "html5", "header", "contact", "logo", "menu")
_part("e3_html5_footer", "html5", "footer")
_part("e4_html5_copyright", "html5", "footer", "copyright")
_part("e5_html5_social", "html5", "footer", "social")
_part("e6_tilda_header", "tilda", "header")
_part("e7_tilda_logo", "tilda", "header", "logo")
_part("e8_tilda_menu", "tilda", "header", "menu")
_part("e9_tilda_phone", "tilda", "header", "phone")
_part("e10_tilda_social", "tilda", "header", "social")
_part("e11_tilda_button", "tilda", "header", "button")
_part("e12_tilda_footer", "tilda", "footer")
_part("e13_tilda_footer_fields", "tilda", "footer", "contact", "copyright", "menu")
_part("e15_bitrix_header", "bitrix", "header")
_part("e16_bitrix_header_fields", "bitrix", "header", "logo", "logo_link", "menu", "search")
_part("e17_bitrix_header_flags", "bitrix", "header", "phones", "cart", "auth")
_part("e18_bitrix_footer", "bitrix", "footer")
_part("e19_bitrix_footer_fields", "bitrix", "footer", "copyright", "menu")
_part("e20_bitrix_footer_contacts", "bitrix", "footer", "contacts", "social", "developer")
_part("f13_labels", "html5", "content", "matched_pattern", "template_name")


@query("f14_assembly", over_blocks("SELECT operation_id, block_type, position, block_no FROM blocks WHERE platform = 'html5'"))
def f14(spark, sf):
    return site_blocks(spark, sf).filter(F.col("platform") == "html5").select("operation_id", "block_type", "position", "block_no")


@query(
    "f9_heuristic_labels",
    over_blocks("""SELECT json_extract_string(content, '$.template_name') AS label, count(*) AS blocks FROM blocks
      WHERE block_type = 'content' AND json_extract_string(content, '$.matched_pattern') = 'false' GROUP BY label"""),
)
def f9(spark, sf):
    found = site_blocks(spark, sf).filter("block_type = 'content' AND get_json_object(content, '$.matched_pattern') = 'false'")
    return found.groupBy(F.get_json_object("content", "$.template_name").alias("label")).agg(F.count("*").alias("blocks"))


def _html5(spark, sf):
    return site(spark, sf).filter(platform(F.col("html")) == "html5")


@query(
    "j1_outcomes",
    f"""WITH {SITE} SELECT md5(url || '|' || CAST(page_id AS VARCHAR)) AS operation_id, CASE WHEN page_id % 10 = 9 THEN 'error' ELSE 'completed' END AS status,
      CASE WHEN page_id % 10 = 9 THEN 'no page' END AS error FROM site""",
)
def j1_outcomes(spark, sf):
    rows = site(spark, sf).withColumn("html", F.when(F.col("page_id") % 10 < 9, F.col("html")))
    return outcomes(rows, at("page_id"), at("page_id + 2")).select("operation_id", "status", "error")


_OWN_MARKER = '<nav><ul><li><a href="/The">'


@query(
    "e26_own_blocks",
    f"""WITH {SITE}, {FACTS} SELECT page_id, 'own' AS platform, 'header' AS block_type, '{{"menu":' || CAST(to_json(nav_items) AS VARCHAR) || '}}' AS content, nav AS html
    FROM shaped WHERE contains(html, '{_OWN_MARKER}')""",
)
def e26_blocks(spark, sf):
    """Blocks of a platform given as data: markers, containers, fields."""
    header, menu = [on("header", cls("own")), on("nav")], ("menu", [on("ul")])
    rules = OwnPlatform((_OWN_MARKER,), {"header": header, "footer": [on("footer", cls("own"))]}, {"header": {"menu": menu}})
    rows = with_page_blocks(site(spark, sf), own={"own": rules}).filter("platform = 'own'")
    return rows.select("page_id", "platform", F.explode("blocks").alias("b")).select("page_id", "platform", "b.block_type", "b.content", "b.html")


_SECTIONS = f"WITH {SITE}, {FACTS}"


@query("f1_candidates", f"{_SECTIONS} SELECT page_id, section_html AS html FROM sections")
def f1(spark, sf):
    nodes = with_nodes(_html5(spark, sf)).withColumn("found", F.expr(sql_candidates()))
    cut = nodes.select("page_id", F.expr(f"transform(found, c -> {sql_inner_html('c')})").alias("found"))
    return cut.select("page_id", F.explode("found").alias("html"))


@query(
    "f4_f5_sizes",
    f"""{_SECTIONS} SELECT page_id, strlen(trim(section_text)) AS text_bytes, strlen(section_html) AS html_bytes, section_image AS has_image
    FROM sections""",
)
def f4_f5(spark, sf):
    rows = with_measured(with_nodes(_html5(spark, sf))).select("page_id", F.explode("measured").alias("m"))
    size = F.octet_length("m.html").cast("long")
    return rows.select("page_id", F.col("m.text_bytes").cast("long").alias("text_bytes"), size.alias("html_bytes"), F.col("m.has_image").alias("has_image"))


_COUNTED = {"images": "<img", "buttons": "<button", "forms": "<form", "tables": "<table"}


@query(
    "f7_feature_counts",
    f"""{_SECTIONS} SELECT page_id, {', '.join(f"(length(section_html) - length(replace(section_html, '{t}', ''))) // {len(t)} AS {n}" for n, t in _COUNTED.items())},
      len(regexp_extract_all(section_html, '<h[1-6]')) AS headings, len(regexp_extract_all(section_html, '<p[> ]')) AS paragraphs FROM sections""",
)
def f7(spark, sf):
    rows = with_nodes(_html5(spark, sf)).withColumn("found", F.expr(sql_candidates()))
    cut = rows.select("page_id", F.expr(f"transform(found, c -> {sql_features('c', sql_below('c'))})").alias("found"))
    named = cut.select("page_id", F.explode("found").alias("f"))
    return named.select("page_id", *[F.col(f"f.{n}").cast("long").alias(n) for n in (*_COUNTED, "headings", "paragraphs")])


@query("d1_nodes_by_tag", f"WITH {SITE} SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href=')) AS links, len(regexp_extract_all(html, '<img[ >]')) AS images FROM site")
def d1(spark, sf):
    nodes = with_nodes(site(spark, sf), tags=("a", "img"), texts=False)
    links = F.size(F.filter("nodes", lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull())).cast("long")
    return nodes.select("page_id", links.alias("links"), F.size(F.filter("nodes", lambda n: n["tag"] == "img")).cast("long").alias("images"))


@query(
    "e26_own_platform",
    f"""WITH {SITE} SELECT CASE WHEN contains(html, '<nav><ul><li><a href="/The">') THEN 'own'
      WHEN contains(html, '<!DOCTYPE html>') OR contains(html, '<html lang') OR contains(html, '<meta charset="UTF-8">') THEN 'html5' ELSE 'other' END AS platform,
      count(*) AS pages FROM site GROUP BY 1""",
)
def e26(spark, sf):
    """A platform given as data comes first in the cascade."""
    markers = {"own": ('<nav><ul><li><a href="/The">',), **MARKERS}
    named = platform(F.col("html"), markers, ("own", *PLATFORMS))
    named = F.when(named.isin("own", "html5"), named).otherwise("other")
    return site(spark, sf).groupBy(named.alias("platform")).agg(F.count("*").alias("pages"))
