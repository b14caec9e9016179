"""Session helpers: work folder, stored intermediate tables, suggested settings."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a large job should start with; none is needed for right results.
SUGGESTED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Pages are long rows: small Arrow batches keep the Python side flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.sql.session.timeZone": "UTC",
}


def work_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster; a local one only where none is set and all tasks run in the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pagestrata-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table to the work folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
