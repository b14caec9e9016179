"""Which site builder made a page."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagestrata.rules import BITRIX_VERSIONS, MARKERS, PLATFORMS


def is_platform(html: Column, markers: Sequence[str]) -> Column:
    """Page holds any of the markers (case-sensitive)."""
    found = F.lit(False)
    for marker in reversed(markers):
        found = html.contains(marker) | found
    return found


def platform(
    html: Column, markers: Mapping[str, Sequence[str]] = MARKERS, order: Sequence[str] = PLATFORMS
) -> Column:
    """First platform in ``order`` with a marker on the page, else ``unknown``."""
    named = F.lit("unknown")
    for name in reversed(order):
        named = F.when(is_platform(html, markers[name]), F.lit(name)).otherwise(named)
    return named


def bitrix_version(html: Column) -> Column:
    version = F.lit("unknown")
    for name, pattern in reversed(BITRIX_VERSIONS):
        version = F.when(html.rlike(pattern), F.lit(name)).otherwise(version)
    return version


def marker_hits(pages: DataFrame, markers: Mapping[str, Sequence[str]] = MARKERS) -> DataFrame:
    """One row per page and marker found on it; markers are rule data, so no join is needed."""
    rules = F.array(
        *[
            F.struct(F.lit(p).alias("platform"), F.lit(m).alias("marker"))
            for p, found in markers.items()
            for m in found
        ]
    )
    hits = F.filter(rules, lambda r: F.contains(F.col("html"), r["marker"]))
    return pages.select("page_id", F.explode(hits).alias("hit")).select("page_id", "hit.platform", "hit.marker")
