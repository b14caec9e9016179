"""Job status as a running table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

STATUS_SCHEMA = "operation_id bigint, ts timestamp_ntz, event_id bigint, status string"


def running_status(events: DataFrame) -> DataFrame:
    """Latest status per operation over a stream of events; use output mode ``update``.

    One small row of state per operation, and events are combined before they
    are shuffled, so a job with very many events is no bottleneck. State is kept for every
    operation ever seen: retention is that of the table of operations itself.
    """
    latest = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("operation_id").agg(latest.alias("s")).select(
        "operation_id", "s.status", F.col("s.ts").alias("updated_at")
    )
