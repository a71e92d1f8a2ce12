"""Streams over several micro-batches: late events, restarts and repeated events."""

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trajectra.sources.working import folder
from trajectra.streaming import events

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _event(i, minutes, user=1, kind=None):
    return i, START + timedelta(minutes=minutes), user, kind or f"e{i}", 1.0, "{}"


def _add(spark, source, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/part={n}")


def _read(spark, source):
    return events.read(spark, source, "*.parquet").drop("part")


def _transitions(rows):
    found = Counter()
    for user in {r[2] for r in rows}:
        kinds = [r[3] for r in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0]))]
        for back, weight in ((1, 1.0), (2, 0.5)):
            for a, b in zip(kinds, kinds[back:]):
                if a != b:
                    found[a, b] += weight
    return found


def test_late_events_stand_at_their_place(spark):
    """Events of three micro-batches, out of order across them, give the transitions of the whole in order."""
    source, sink = folder(spark, "events"), folder(spark, "stream")
    batches = [
        [_event(1, 0), _event(2, 30), _event(3, 50, kind="e1"), _event(10, 5, 2), _event(11, 55, 2)],
        [_event(4, 40), _event(5, 10), _event(6, 100), _event(12, 20, 2)],  # 4 and 5 belong between those of the first batch
        [_event(7, 95), _event(8, 400), _event(13, 390, 2)],
    ]
    for n, rows in enumerate(batches):
        _add(spark, source, n, rows)
        events.drain(events.transition_parts(_read(spark, source)), sink)
    rows = [r for b in batches for r in b]
    latest = max(r[1] for r in rows) - timedelta(hours=1)
    got = events.drain(events.transition_parts(_read(spark, source)), sink)
    want = _transitions([r for r in rows if r[1] <= latest])
    assert {(r.src, r.dst): r.n for r in got.groupBy("src", "dst").agg(F.sum("count").alias("n")).collect()} == dict(want)
    assert want["e1", "e5"] == 1.0 and ("e1", "e2") in want  # 5 came late, after 2 had been seen


def test_restart_goes_on_where_it_ended(spark):
    source, sink = folder(spark, "events"), folder(spark, "stream")
    _add(spark, source, 0, [_event(i, i, kind="a") for i in range(5)])
    once = lambda: events.distinct_events(_read(spark, source))
    assert events.drain(once(), sink).count() == 5
    assert events.drain(once(), sink).count() == 5  # nothing new
    _add(spark, source, 1, [_event(i, i + 10, kind="b") for i in range(3, 9)])  # 3 and 4 again
    got = events.drain(once(), sink)
    assert Counter(r.event_id for r in got.collect()) == Counter(range(9))
    # a batch whose files were written before a run was cut off is written over, not added
    last = max(r.batch for r in spark.read.parquet(f"{sink}/rows").select("batch").distinct().collect())
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/checkpoint/commits/{last}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
    assert Counter(r.event_id for r in events.drain(once(), sink).collect()) == Counter(range(9))


def test_windows_of_the_last_batch_count(spark):
    source, sink = folder(spark, "events"), folder(spark, "stream")
    for n in range(2):
        _add(spark, source, n, [_event(10 * n + i, 60 * 24 * n + i, kind="a") for i in range(4)])
        got = events.drain(events.window_counts(_read(spark, source)), sink, "complete")
    assert sorted(r.n for r in got.collect()) == [4, 4]
    sliding = events.drain(events.window_counts(_read(spark, source), "1 day", "12 hours"), folder(spark, "stream"), "complete")
    assert sorted(r.n for r in sliding.collect()) == [4, 4, 4, 4]
