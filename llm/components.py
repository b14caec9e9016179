"""Connected components of links between rows, with lineage cut after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from llm.common import discard, stored


def _stars(links: DataFrame) -> DataFrame:
    """One round: each node's larger neighbours, then its smaller ones, are hung on its least neighbour.

    ``links`` is (hi, lo) with hi > lo. Minima are taken with partial aggregation; the joins bring a
    row back to its node's minimum and are ordinary shuffled joins that can split a hot node.
    """
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = large.join(low, "hi")
    up = joined.select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo")).where("hi <> lo")
    return up.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b) links; root is the least node of its component.

    Alternates the two star steps until the links no longer change; rounds grow with the logarithm of the
    component size. Links with a null end and self-links are no links. No links: no rows.
    """
    now = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "links",
    )
    mark = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(hi, lo) as decimal(38, 0)))").alias("s")).first()
        if row["n"] == 0 or (row["n"], row["s"]) == mark:
            break
        mark = (row["n"], row["s"])
        then = stored(_stars(now), "links")
        discard(now)
        now = then
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
