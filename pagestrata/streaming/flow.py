"""The flow of job statuses as a stream: steps judged in order, open jobs that take too long, state that ends.

Events may come out of order by at most ``delay``. They wait in the state of their operation until the watermark has passed them and are then judged in order of time and id, so the
result does not depend on how the stream is cut into batches; an event that the watermark of the batch before had passed is dropped by Spark. Rows of kind ``step`` equal those of ``status_steps`` over the same
events; a row of kind ``timeout`` tells that an operation was still pending or processing ``limit`` after its last event. An operation without
events for ``retention`` leaves the state; an event after that is judged like a first one.

Nulls: events with a null time are dropped, those of a null operation are one operation's, a null status is a step that is not allowed. Events of one time are ordered by id,
repeated rows are judged each. The state of an operation holds its events of one delay at most.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

import pagestrata
from pagestrata.sources.store import ALLOWED_STEPS

cloudpickle.register_pickle_by_value(pagestrata)

FLOW_SCHEMA = "operation_id bigint, kind string, event_id bigint, at_us bigint, before string, status string, allowed boolean"
_STATE_SCHEMA = "seen boolean, last string, last_us bigint, warned boolean, waiting string"
_NEW = (False, None, 0, False)
OPEN = ("pending", "processing")


def is_allowed(before: str | None, status: str | None) -> bool:
    """Whether a status may follow the one before; a first one, or one after a null one, has to be pending."""
    if status is None:
        return False
    if before is None:
        return status == "pending"
    return before in ALLOWED_STEPS and status in (before, *ALLOWED_STEPS[before])


def judged(state: tuple, events: list[tuple], now_us: int, limit_us: int, retention_us: int) -> tuple[tuple, list[tuple]]:
    """The state (seen, last, last_us, warned) after events (us, id, status) in order, with no other before ``now_us``, and rows (kind, id, us, before, status, allowed)."""
    seen, last, last_us, warned = state
    rows = []
    for us, event_id, status in [*events, (now_us, None, None)]:
        if seen and not warned and last in OPEN and us > last_us + limit_us:
            rows.append(("timeout", None, last_us + limit_us, last, "error", False))
            warned = True
        if seen and us > last_us + retention_us:
            seen, last, last_us, warned = _NEW
        if event_id is not None:
            rows.append(("step", event_id, us, last, status, is_allowed(last, status)))
            seen, last, last_us, warned = True, status, us, False
    return (seen, last, last_us, warned), rows


def next_deadline(state: tuple, waiting: list[tuple], limit_us: int, retention_us: int) -> int | None:
    """The time at which an operation has to be looked at again."""
    seen, last, last_us, warned = state
    times = [us for us, _, _ in waiting]
    if seen:
        times.append(last_us + retention_us)
        if last in OPEN and not warned:
            times.append(last_us + limit_us)
    return min(times, default=None)


def status_flow(events: DataFrame, delay: timedelta = timedelta(minutes=10), limit: timedelta = timedelta(hours=1), retention: timedelta = timedelta(days=30)) -> DataFrame:
    """Rows of FLOW_SCHEMA, with ``at`` as a timestamp, for a stream of events ``operation_id, ts, event_id, status``; use output mode ``append``."""
    if retention < limit:
        raise ValueError("retention must not be shorter than the limit")
    limit_us, retention_us = limit // timedelta(microseconds=1), retention // timedelta(microseconds=1)

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        *state, waiting = group.get if group.exists else (*_NEW, "[]")
        waiting = [tuple(e) for e in json.loads(waiting)]
        for frame in frames:
            names = [None if pd.isna(s) else s for s in frame["status"]]
            waiting += zip(frame["us"].tolist(), frame["event_id"].tolist(), names)
        passed = group.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda e: (e[0], e[1]))
        ready = [e for e in waiting if e[0] <= passed]
        waiting = waiting[len(ready) :]
        state, rows = judged(tuple(state), ready, passed + 1, limit_us, retention_us)
        deadline = next_deadline(state, waiting, limit_us, retention_us)
        if deadline is None:
            group.remove()
        else:
            group.update((*state, json.dumps(waiting)))
            group.setTimeoutTimestamp(max(-(-deadline // 1000), passed // 1000 + 1))
        if rows:
            kinds, ids, times, before, status, allowed = zip(*rows)
            made = {"operation_id": [key[0]] * len(rows), "kind": kinds, "event_id": pd.array(ids, "Int64"), "at_us": times, "before": before, "status": status, "allowed": allowed}
            yield pd.DataFrame(made)

    read = events.where("ts IS NOT NULL").select("operation_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status")
    timed = read.withWatermark("ts", f"{int(delay.total_seconds() * 1000)} milliseconds").withColumn("us", F.unix_micros("ts"))
    found = timed.groupBy("operation_id").applyInPandasWithState(run, FLOW_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("operation_id", "kind", "event_id", F.timestamp_micros("at_us").alias("at"), "before", "status", "allowed")
