"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's ratio is the number of the host's pages that contain it over the number of the host's pages; lines
over the boilerplate ratio, on at least ``min_pages`` pages, are dropped from every page of the host.

Counts are summed in each task before the shuffle, so that neither a host nor a line with a large share of all rows is slow. The
lines dropped at a host number at most its mean of lines per page over the ratio; they go to its pages as one row
per host, by broadcast for hosts with a large share.

Nulls: a null page text has no lines and counts as a page; a null host, or a URL without one, is the host ''. Repeated rows are pages each.
Blank lines are no lines. An empty table gives no rows. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from llm.common import stored, with_hot

#: What separates lines of text in HTML: scripts, styles and comments whole, and any tag. Each that is not closed runs to the end of the page, so
#: none is tried twice over the same text.
BREAKS = "(?is)<script[^>]*>.*?(?:</script>|\\z)|<style[^>]*>.*?(?:</style>|\\z)|<!--.*?(?:-->|\\z)|<[^>]*(?:>|\\z)"
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines_of(text: Column) -> Column:
    """Lines that are not blank, without the spaces around them."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.trim(line))
    return F.filter(cut, lambda line: line != "")


def text_of_html(html: Column) -> Column:
    """Text of a page with a line break for each tag."""
    return F.regexp_replace(html, BREAKS, "\n")


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, pages, common) of rows (host, lines): how many pages a host has and which lines, by digest, are dropped there."""
    by_host = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform("lines", lambda line: _digest(line)))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = counts.join(by_host, "host").where(F.col("n") / F.col("pages") > max_ratio)
    return by_host.join(common.groupBy("host").agg(F.collect_list("line").alias("common")), "host", "left")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def dedup_lines(pages: DataFrame, max_ratio: float = 0.3, min_pages: int = 3, id_col: str = "page_id", host_col: str = "host", text_col: str = "text") -> DataFrame:
    """One row per page: page_id, host, n_lines, n_dropped, text (the lines that stay)."""
    host = F.coalesce(F.col(host_col), F.lit(""))
    rows = stored(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), lines_of(F.col(text_col)).alias("lines")), "lines")
    dropped = stored(boilerplate(rows, max_ratio, min_pages), "boilerplate")
    total = rows.count()
    met = with_hot(rows, dropped.withColumn("weight", F.col("pages")), "host", "weight", total)
    stays = F.filter("lines", lambda line: F.col("common").isNull() | ~F.array_contains(F.col("common"), _digest(line)))
    return met.withColumn("stays", stays).select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stays")).cast("long").alias("n_dropped"),
        F.array_join("stays", "\n").alias("text"),
    )
