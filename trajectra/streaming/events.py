"""Structured Streaming over the event table: windows, sessions and incremental transitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

DELAY = "1 hour"


def read(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """The stream of events files of a folder; ts is a timestamp, as watermarks need."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows, or sliding ones."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    found = events.withWatermark("ts", DELAY).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """(user_id, session_start, n): a session ends after a gap without events."""
    found = events.withWatermark("ts", DELAY).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("session_start"), "n")


def distinct_events(events: DataFrame) -> DataFrame:
    """Events whose id was not seen within the watermark."""
    return events.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"])


class OrderedTransitions(StatefulProcessor):
    """The transitions of one user, in the order of time: events are held until the watermark has passed them.

    So an event that comes late, in the same micro-batch or a later one, still stands at its place; a timer at the first event
    held sees to those after which no more come. What is kept of a user is what is held and the last two event types.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "before string, last string")
        self.held = handle.getListState("held", "ts long, event_id long, event_type string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(t), int(i), e) for batch in rows for t, i, e in zip(batch["ts_us"], batch["event_id"], batch["event_type"], strict=True)]
        yield from self.released([*self.held.get(), *new], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.released(list(self.held.get()), timerValues.getCurrentWatermarkInMs())

    def released(self, events: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        events = sorted(tuple(e) for e in events)
        ready = [e for e in events if e[0] <= watermark * 1000]
        rest = events[len(ready) :]
        last = list(self.last.get()) if self.last.exists() else [None, None]
        out = []
        for _, _, kind in ready:
            for back, weight in ((last[1], 1.0), (last[0], 0.5)):
                if back is not None and back != kind:
                    out.append((back, kind, weight))
            last = [last[1], kind]
        if ready:
            self.last.update((last[0], last[1]))
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=["src", "dst", "count"])

    def close(self) -> None:
        pass


def transition_parts(events: DataFrame) -> DataFrame:
    """(src, dst, count) as the watermark passes them: 1 for the next event type of a user, 0.5 for the next but one."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.withWatermark("ts", DELAY).withColumn("ts_us", F.unix_micros("ts"))
    return rows.groupBy("user_id").transformWithStateInPandas(OrderedTransitions(), "src string, dst string, count double", "Append", "EventTime")


def end(spark: SparkSession, folder: str, last: DataFrame | None = None, after: str = "2 hours") -> None:
    """The folder of a stream's end: no row, or with `last` (ts), one of no user later than its greatest ts by more than the delay.

    Read beside the events of a stream that is over, that row moves the watermark past the last of them, so none stays held.
    """
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.createDataFrame([], schema)
    if last is not None:
        late = last.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts")).where("ts IS NOT NULL")  # one row
        rows = late.select(*[F.col(c).cast(t) if c == "ts" else F.lit("" if t == "string" else -1).cast(t).alias(c) for c, t in rows.dtypes])
    rows.coalesce(1).write.mode("append").parquet(folder)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now and was not before, through the stream, as Parquet files of `folder`.

    Every micro-batch is written under its number, over what an earlier try left, and the progress is kept beside it: a run
    that was cut off, or one with more input, goes on where the last one ended. In complete mode the last batch counts.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")
