"""Depth-limited traversal of a link graph held in a page table.

The crawl's state is a folder with two bucketed tables: the pages' link lists by page key, and the visited URLs by seed and URL, a partition per depth. A round reads the newest partition, joins it with
the link lists, and anti-joins what it finds with all visited URLs; neither table is shuffled for that, only the frontier and its links are. What is new becomes the next
partition. A round that is done enters a ledger, so a crawl whose driver was lost goes on with the round that it was in. Keys with many rows are split by the adaptive skew join
where both sides are shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagestrata.functions.urls import domain_key, in_domains, link_key, normal_url, resolved_link, url_parts
from pagestrata.operators.links import with_hrefs
from pagestrata.operators.skew import numbered
from pagestrata.rules import DEFAULT_CRAWL_DELAY_SECONDS
from pagestrata.session import work_dir


def link_lists(pages: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """One row per page key: ``page_key, status, targets``; targets are normal, allowed and distinct."""
    keyed = pages.select("page_id", link_key(F.col("url")).alias("page_key"), "status", "html")
    df = with_hrefs(keyed).withColumn("__base", url_parts(F.col("page_key")))
    links = F.transform("hrefs", lambda h: resolved_link(F.col("__base"), h))
    df = df.withColumn("__links", F.filter(links, lambda u: u.isNotNull() & in_domains(u, allowed)))
    targets = F.array_distinct(F.transform("__links", normal_url))
    df = df.select("page_id", "page_key", "status", targets.alias("targets"))
    # Several pages may share a key; the first one stands for it.
    first = F.min_by(F.struct("status", "targets"), "page_id")
    return df.groupBy("page_key").agg(first.alias("p")).select("page_key", "p.status", "p.targets")


class CrawlState:
    """The tables of one crawl below a folder; opened again by another session it goes on where the ledger ends."""

    VISITED = "seed_url STRING, url STRING, page_key STRING, max_depth INT, depth INT"
    LISTS = "page_key STRING, status INT, targets ARRAY<STRING>"

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path = spark, path
        self.lists, self.visited = (f"crawl_{kind}_{uuid.uuid4().hex}" for kind in ("lists", "visited"))
        self.buckets = buckets
        if self.done("lists"):
            self.buckets = spark.read.schema("buckets int").parquet(f"{path}/ledger/lists").first()["buckets"]
        self._create(self.lists, self.LISTS, "", "page_key", f"{path}/lists")
        self._create(self.visited, self.VISITED, "PARTITIONED BY (depth) ", "seed_url, url", f"{path}/visited")
        if self._exists("visited"):
            spark.sql(f"ALTER TABLE {self.visited} RECOVER PARTITIONS")

    def _create(self, name: str, columns: str, parts: str, keys: str, location: str) -> None:
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {parts}CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{location}'")

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def done(self, step: str) -> bool:
        return self._exists(f"ledger/{step}/_SUCCESS")

    def finish(self, step: str, **facts: int) -> None:
        row = self.spark.range(1).select(*(F.lit(v).cast("int" if k == "buckets" else "long").alias(k) for k, v in facts.items()))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/{step}")

    def found(self, step: str) -> int:
        return self.spark.read.schema("rows long").parquet(f"{self.path}/ledger/{step}").first()["rows"]

    def store_lists(self, lists: DataFrame) -> None:
        if not self.done("lists"):
            lists.select("page_key", F.col("status").cast("int"), "targets").repartition(self.buckets, "page_key").write.insertInto(self.lists, overwrite=True)
            self.finish("lists", buckets=self.buckets)

    def store_round(self, depth: int, rows: DataFrame) -> int:
        """Make the rows the partition of a depth, in place of what a lost driver has left of it; how many they are."""
        if self._exists(f"visited/depth={depth}"):
            self.spark.sql(f"ALTER TABLE {self.visited} DROP IF EXISTS PARTITION (depth = {depth})")
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/visited/depth={depth}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        rows.select("seed_url", "url", "page_key", "max_depth").repartition(self.buckets, "seed_url", "url").createOrReplaceTempView(f"{self.visited}_round")
        self.spark.sql(f"INSERT INTO {self.visited} PARTITION (depth = {depth}) SELECT seed_url, url, page_key, max_depth FROM {self.visited}_round")
        n = self.rows(depth).count()
        self.finish(f"round-{depth}", rows=n)
        return n

    def rows(self, depth: int | None = None) -> DataFrame:
        """Visited rows of a depth, or of all depths."""
        table = self.spark.table(self.visited)
        return table if depth is None else table.where(F.col("depth") == depth)

    def close(self) -> None:
        """Forget the tables' names; the folder stays."""
        for name in (self.lists, self.visited):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _page_key() -> Column:
    """Visited URLs are normal already: without their query they are page keys."""
    return F.regexp_extract("url", "^([^?]*)", 1)


def crawl(
    pages: DataFrame,
    seeds: DataFrame,
    allowed: Sequence[str],
    state: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Visited URLs ``seed_url, url, depth, status`` by breadth; only pages with status 200 are expanded.

    ``seeds`` has ``seed_url`` and ``max_depth``.  A URL without a page has a null status. ``state`` names a folder for the crawl's state: a crawl of that folder
    that was cut off goes on, one that was done is read again; without it the crawl has a new folder. ``buckets`` is the number of buckets of a new state (default: that of shuffle partitions).
    """
    spark = pages.sparkSession
    folder = state or f"{work_dir(spark)}/crawl-{uuid.uuid4().hex}"
    kept = CrawlState(spark, folder, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    kept.store_lists(link_lists(pages, allowed))
    if not kept.done("round-0"):
        start = seeds.filter(in_domains(F.col("seed_url"), allowed))
        start = start.withColumn("url", normal_url(F.col("seed_url"))).filter(F.col("url").isNotNull())
        first = start.select("seed_url", "url", _page_key().alias("page_key"), F.col("max_depth").cast("int").alias("max_depth"))
        kept.store_round(0, first.dropDuplicates(["seed_url", "url"]))
    depth, lists = 0, spark.table(kept.lists)
    while kept.found(f"round-{depth}"):
        if not kept.done(f"round-{depth + 1}"):
            frontier = kept.rows(depth).filter(F.col("depth") < F.col("max_depth"))
            hits = frontier.join(lists.filter(F.col("status") == 200).select("page_key", "targets"), "page_key")
            found = hits.select("seed_url", F.explode("targets").alias("url"), "max_depth").dropDuplicates(["seed_url", "url"])
            seen = kept.rows().where(F.col("depth") <= depth).select("seed_url", "url")
            fresh = found.join(seen.hint("merge"), ["seed_url", "url"], "left_anti")
            kept.store_round(depth + 1, fresh.withColumn("page_key", _page_key()))
        depth += 1
    visited, status = kept.rows().where(F.col("depth") < depth), lists.select("page_key", "status")
    return visited.join(status, "page_key", "left").select("seed_url", "url", "depth", "status")


def crawl_report(visited: DataFrame) -> DataFrame:
    """Links of each seed with the seed's link count; one row per link, so a large crawl stays distributed."""
    links = visited.filter(F.col("status") == 200).select("seed_url", "url", "depth")
    counts = links.groupBy("seed_url").agg(F.count("*").alias("links_count"))
    return links.join(counts, "seed_url")


def fetch_schedule(urls: DataFrame, delay_seconds: int = DEFAULT_CRAWL_DELAY_SECONDS, bucket: Column | None = None) -> DataFrame:
    """Start time in seconds of each fetch, so that one domain is asked at most once per delay.

    Order inside a domain: depth, then hash bucket of the URL, then URL.
    """
    keyed = urls.withColumn("domain", domain_key(F.col("url")))
    bucket = F.substring(F.md5("url"), 1, 3) if bucket is None else bucket
    placed = numbered(keyed, "domain", ("depth", "url"), bucket, "slot")
    return placed.withColumn("start_seconds", F.col("slot") * F.lit(delay_seconds))
