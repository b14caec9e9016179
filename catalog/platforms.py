"""Sources, text predicates, platform detection, fragments: no node table needed."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    BITRIX_VERSION,
    MARKERS,
    PLATFORM,
    SITE,
    WORDPRESS,
    pages,
    query,
    site,
    sql_string,
    table,
)
from pagestrata import rules
from pagestrata.functions.text import has_contact, likely_phone, valid_phone
from pagestrata.operators import fields
from pagestrata.operators.containers import wordpress_fragment
from pagestrata.operators.detect import bitrix_version, is_platform, marker_hits, platform
from pagestrata.sources.pages import key_collisions, raw_files, read_pages

_FILE_KEY = "regexp_replace(regexp_replace(url, '^http://', ''), '^https://', '')"
_FILE_KEY = f"translate({_FILE_KEY}, '/\\:*?\"<>|', '_________')"


@query(
    "a1_page_source",
    "SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS bytes FROM pages",
)
def a1(spark, sf):
    df = read_pages(spark, f"{sf}/pages.parquet")
    return df.select("page_id", "url", F.octet_length("html").cast("bigint").alias("bytes"))


@query(
    "a2_raw_page_files",
    f"""SELECT page_id, {_FILE_KEY} || '.' || CAST(page_id AS VARCHAR) || '.html' AS file_name,
    CAST(strlen(html) AS BIGINT) AS bytes, md5(html) AS checksum FROM pages""",
)
def a2(spark, sf):
    files = raw_files(pages(spark, sf))
    return files.select("page_id", "file_name", F.col("bytes").cast("bigint").alias("bytes"), F.md5("html").alias("checksum"))


@query("a3_file_key", f"SELECT page_id, {_FILE_KEY} AS file_key FROM pages")
def a3(spark, sf):
    return raw_files(pages(spark, sf)).select("page_id", "file_key")


@query(
    "a3_file_key_collisions",
    """SELECT file_key, count(*) AS pages FROM (
      SELECT regexp_replace(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^http://', ''), '^https://', '') AS u,
        translate(u, '/:', '__') AS file_key FROM pages) GROUP BY file_key HAVING count(*) > 1""",
)
def a3_collisions(spark, sf):
    # Query and fragment are cut first, as links have none: that is where keys meet.
    bare = pages(spark, sf).withColumn("url", F.regexp_extract("url", "^([^?#]*)", 1))
    return key_collisions(bare)


def _flag(name):
    columns = "(" + " OR ".join(f"contains(html, {sql_string(m)})" for m in MARKERS[name]) + ")"

    def run(spark, sf):
        return site(spark, sf).select("page_id", is_platform(F.col("html"), rules.MARKERS[name]).alias("found"))

    return f"WITH {SITE} SELECT page_id, {columns} AS found FROM site", run


for _id, _name in (("c1_is_html5", "html5"), ("c2_is_wordpress", "wordpress"), ("c3_is_tilda", "tilda"), ("c4_is_bitrix", "bitrix")):
    _sql, _run = _flag(_name)
    query(_id, _sql)(_run)


@query("c5_detect_platform", f"WITH {SITE} SELECT page_id, {PLATFORM} AS platform FROM site")
def c5(spark, sf):
    return site(spark, sf).select("page_id", platform(F.col("html")).alias("platform"))


@query(
    "c5_platform_counts",
    f"WITH {SITE} SELECT platform, count(*) AS pages FROM (SELECT {PLATFORM} AS platform FROM site) GROUP BY platform",
)
def c5_counts(spark, sf):
    named = site(spark, sf).select(platform(F.col("html")).alias("platform"))
    return named.groupBy("platform").agg(F.count("*").alias("pages"))


@query("c6_bitrix_version", f"WITH {SITE} SELECT page_id, {BITRIX_VERSION} AS version FROM site")
def c6(spark, sf):
    return site(spark, sf).select("page_id", bitrix_version(F.col("html")).alias("version"))


_MARKER_ROWS = ", ".join(f"('{p}', {sql_string(m)})" for p, found in MARKERS.items() for m in found)


@query(
    "c7_marker_hits",
    f"""WITH {SITE}, markers(platform, marker) AS (VALUES {_MARKER_ROWS})
    SELECT platform, marker, count(*) AS pages FROM site, markers WHERE contains(html, marker) GROUP BY platform, marker""",
)
def c7(spark, sf):
    return marker_hits(site(spark, sf)).groupBy("platform", "marker").agg(F.count("*").alias("pages"))


@query(
    "e14_likely_phone",
    """SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g')) >= 7 AND (contains(text, '+') OR contains(text, '(')) AS likely
    FROM documents""",
)
def e14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", likely_phone(F.col("text")).alias("likely"))


@query(
    "e21_valid_phone",
    "SELECT doc_id, regexp_matches(regexp_replace(text, '[^0-9+]', '', 'g'), '[0-9]{5,}') AS valid FROM documents",
)
def e21(spark, sf):
    return table(spark, sf, "documents").select("doc_id", valid_phone(F.col("text")).alias("valid"))


@query(
    "f11_has_phone_or_mail",
    r"""SELECT doc_id, regexp_matches(text, '\+\d{1,3}\s*\(\d{3,}\)\s*\d{3,}') OR regexp_matches(text, '\+\d{10,}')
      OR regexp_matches(text, '\d{3,}[\s-]?\d{3,}[\s-]?\d{2,}')
      OR regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AS found FROM documents""",
)
def f11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", has_contact(F.col("text")).alias("found"))


_WP_ALL = f"WITH {SITE}, wp_pages AS (SELECT page_id, html FROM site), {WORDPRESS}"


@query("e22_wordpress_header", f"{_WP_ALL} SELECT page_id, html FROM wp_header")
def e22(spark, sf):
    df = site(spark, sf).select("page_id", wordpress_fragment("header").alias("html"))
    return df.filter(F.col("html").isNotNull())


@query("e23_wordpress_header_fields", f"{_WP_ALL} SELECT page_id, contacts, logo, menu, search FROM wp_header")
def e23(spark, sf):
    df = site(spark, sf).withColumn("part", wordpress_fragment("header")).filter(F.col("part").isNotNull())
    return df.select("page_id", *[c.alias(n) for n, c in fields.wordpress_header(F.col("part")).items()])


@query("e24_wordpress_footer", f"{_WP_ALL} SELECT page_id, html FROM wp_footer")
def e24(spark, sf):
    df = site(spark, sf).select("page_id", wordpress_fragment("footer").alias("html"))
    return df.filter(F.col("html").isNotNull())


@query("e25_wordpress_footer_fields", f"{_WP_ALL} SELECT page_id, copyright, nav_links, social, widgets FROM wp_footer")
def e25(spark, sf):
    df = site(spark, sf).withColumn("part", wordpress_fragment("footer")).filter(F.col("part").isNotNull())
    return df.select("page_id", *[c.alias(n) for n, c in fields.wordpress_footer(F.col("part")).items()])
