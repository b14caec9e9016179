"""Links of pages: extraction, resolution, allow-list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagestrata.functions.urls import domain_suffixes, host_name, resolved_link, url_parts
from pagestrata.operators.dom import with_nodes


def with_hrefs(pages: DataFrame, into: str = "hrefs") -> DataFrame:
    """Add the ``href`` of every link of a page, but empty ones and page-internal anchors."""
    df = with_nodes(pages, tags=("a",), texts=False)
    return df.withColumn(into, kept_hrefs(F.col("nodes"))).drop("nodes")


def kept_hrefs(nodes: Column) -> Column:
    """The ``href`` of each of an array of link nodes, but empty ones and page-internal anchors."""
    hrefs = F.transform(nodes, lambda n: n["attrs"]["href"])
    return F.filter(hrefs, lambda h: h.isNotNull() & (h != "") & ~h.startswith("#"))


def page_links(pages: DataFrame, base: str = "url") -> DataFrame:
    """One row per link: page columns without ``html``, ``link_no``, ``href``, and ``link`` (null if not http)."""
    keep = [c for c in pages.columns if c != "html"]
    df = with_hrefs(pages).withColumn("__base", url_parts(F.col(base)))
    rows = df.select(*keep, "__base", F.posexplode_outer("hrefs").alias("link_no", "href"))
    rows = rows.filter(F.col("href").isNotNull())
    return rows.withColumn("link", resolved_link(F.col("__base"), F.col("href"))).drop("__base")


def allowed_by_table(rows: DataFrame, url: str, domains: DataFrame) -> DataFrame:
    """Rows whose host is, or lies below, a domain of a (possibly large) table with column ``domain``.

    The test runs once per distinct host, as an equi-join on the host's
    domain suffixes instead of a comparison with every domain.
    """
    rows = rows.withColumn("__host", host_name(F.col(url)))
    hosts = rows.select("__host").filter(F.col("__host").isNotNull()).distinct()
    suffixes = hosts.select("__host", F.explode(domain_suffixes(F.col("__host"))).alias("domain"))
    allowed = suffixes.join(domains.select("domain"), "domain", "left_semi").select("__host").distinct()
    return rows.join(allowed, "__host", "left_semi").drop("__host")


def seeds_with_defaults(seeds: DataFrame, max_depth: int, concurrency: int) -> DataFrame:
    """Effective parameters: the request's value if positive, else the default; depth at least 1."""
    depth, workers = F.col("max_depth"), F.col("concurrency")
    return seeds.select(
        "seed_url",
        F.greatest(F.when(depth > 0, depth).otherwise(F.lit(max_depth)), F.lit(1)).alias("max_depth"),
        F.greatest(F.when(workers > 0, workers).otherwise(F.lit(concurrency)), F.lit(1)).alias("concurrency"),
    )


__all__: Sequence[str] = ("with_hrefs", "page_links", "allowed_by_table", "seeds_with_defaults")
