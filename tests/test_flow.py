import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pagestrata.sources.store import status_steps
from pagestrata.streaming import flow

SCHEMA = "operation_id bigint, ts timestamp, event_id bigint, status string"
START = datetime(2024, 1, 1)
STATUSES = ["pending", "processing", "completed", "error", "odd", None]


def run(spark, folder, batches, **settings_):
    """The flow over batches of events, a file each in order of arrival, and a last event far ahead that lets time pass."""
    for i, batch in enumerate([*batches, [(-1, START + timedelta(days=4000), -1, "completed")]]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = flow.status_flow(stream, **settings_)
    found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out").where("operation_id >= 0 OR operation_id IS NULL")


def test_steps_equal_the_batch_and_do_not_depend_on_the_order_within_the_delay(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.randrange(6), START + timedelta(minutes=i // 2), i, rng.choice(STATUSES)) for i in range(120)]
    shuffled = sorted(events, key=lambda e: e[2] + rng.random() * 15)  # at most about eight minutes out of order
    got = run(spark, tmp_path, [shuffled[i : i + 30] for i in range(0, 120, 30)], delay=timedelta(minutes=10), limit=timedelta(minutes=7), retention=timedelta(days=100))
    steps = got.where("kind = 'step'").select("operation_id", "event_id", F.col("at").alias("ts"), "before", "status", "allowed")
    want = status_steps(spark.createDataFrame(events, SCHEMA)).select(*steps.columns)
    assert sorted(map(str, steps.collect())) == sorted(map(str, want.collect())) and steps.count() == 120
    times = []
    for op in range(6):
        own = sorted((e[1], e[2], e[3]) for e in events if e[0] == op)
        for (ts, _, status), after in zip(own, [*own[1:], (datetime.max, 0, None)]):
            if status in ("pending", "processing") and after[0] > ts + timedelta(minutes=7):
                times.append((op, ts + timedelta(minutes=7), status))
    assert sorted((r.operation_id, r.at, r.before) for r in got.where("kind = 'timeout'").collect()) == sorted(times) and times


def test_late_events_are_dropped_and_an_operation_starts_anew_after_its_retention(spark, tmp_path):
    hour = timedelta(hours=1)
    first = [(1, START, 1, "pending"), (2, START, 2, "pending"), (None, START, 9, "processing")]
    then = [(1, START + 100 * hour, 3, "processing"), (2, START + 2 * hour, 4, "processing")]  # the second is later than the watermark of what came before
    late = [(2, START + timedelta(minutes=30), 5, "error"), (1, START + 101 * hour, 6, "completed")]
    between = [(7, START + 100 * hour, 7, "pending")]  # Spark drops what the watermark of the batch before had passed
    got = run(spark, tmp_path, [first, then, between, late], delay=timedelta(minutes=1), limit=10 * hour, retention=50 * hour)
    steps = {r.event_id: (r.before, r.allowed) for r in got.where("kind = 'step'").collect()}
    assert steps == {1: (None, True), 2: (None, True), 9: (None, False), 3: (None, False), 4: ("pending", True), 6: ("processing", True), 7: (None, True)}
    assert sorted((r.operation_id or 0, r.before) for r in got.where("kind = 'timeout'").collect()) == [(0, "processing"), (1, "pending"), (2, "processing"), (7, "pending")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.sampled_from(STATUSES[:4])), max_size=12), st.lists(st.integers(0, 400), max_size=5), st.integers(1, 60), st.integers(60, 150))
def test_judging_in_pieces_equals_judging_at_once(events, cuts, limit, retention):
    events = [(us, i, s) for i, (us, s) in enumerate(sorted(events))]
    whole_state, whole = flow.judged(flow._NEW, events, 1000, limit, retention)
    state, rows, done = flow._NEW, [], -1
    for cut in [*sorted(cuts), 999]:
        part = [e for e in events if done < e[0] <= cut]
        state, more = flow.judged(state, part, cut + 1, limit, retention)
        rows, done = rows + more, max(done, cut)
        due = flow.next_deadline(state, [], limit, retention)
        assert due is None or due > cut
    assert rows == whole and state == whole_state == flow._NEW


def test_settings_are_checked(spark):
    with pytest.raises(ValueError, match="retention"):
        flow.status_flow(spark.createDataFrame([], SCHEMA), limit=timedelta(days=2), retention=timedelta(days=1))
