"""Numbering that holds when one group has a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

def numbered(df: DataFrame, group: str, order: Sequence[str], bucket: Column, into: str) -> DataFrame:
    """Number the rows of each group from 0, in order of (``order`` columns but the last, bucket, last column).

    No task sees a whole group: rows are numbered inside (group, order prefix,
    bucket), and the start of each bucket comes from the bucket counts alone.
    """
    *prefix, last = order
    keys = [group, *prefix, "__bucket"]
    df = df.withColumn("__bucket", bucket)
    counts = df.groupBy(*keys).agg(F.count("*").alias("__rows"))
    before = Window.partitionBy(group).orderBy(*prefix, "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(last)) - 1
    ranked = df.withColumn("__inside", inside)
    return ranked.join(starts, keys).withColumn(into, F.col("__start") + F.col("__inside")).drop(
        "__bucket", "__start", "__inside"
    )
