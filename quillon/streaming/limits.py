"""Streams of events: a true sliding-window limiter, daily throughput, and a sweep of a queue."""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quillon.operators import changes

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """Decides events of a bucket in the order of event time, once the watermark has passed them.

    Events that are not yet due wait in a list; times of decided ones are kept
    while a window that is still to come may need them. A timer at the first
    waiting event, or at the end of the last window, is the only one that counts:
    when it fires, what is due is decided or the bucket is forgotten.
    """

    def __init__(self, window_us: int, limit: int):
        self.window_us, self.limit = window_us, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long")
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key, rows, timerValues):
        """A row carries its time in microseconds, since list states do."""
        first = None
        for batch in rows:
            for event_id, at in zip(batch["event_id"].tolist(), batch["at"].tolist()):
                self.waiting.appendValue((at, event_id))
                first = at if first is None else min(first, at)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark = timerValues.getCurrentWatermarkInMs()
        due_until = watermark * 1000
        waiting = sorted((r[0], r[1]) for r in self.waiting.get())
        due, later = [x for x in waiting if x[0] <= due_until], [x for x in waiting if x[0] > due_until]
        times = [r[0] for r in self.times.get()] if self.times.exists() else []
        out, start = [], 0
        for at, group in groupby(due, key=itemgetter(0)):  # events of one time count for each other
            ids = [event_id for _, event_id in group]
            times += [at] * len(ids)
            while times[start] <= at - self.window_us:
                start += 1
            used = len(times) - start
            out += [(key[0], event_id, at, used, used <= self.limit) for event_id in ids]
        times = [t for t in times[start:] if t > due_until - self.window_us]
        for state, kept in ((self.waiting, later), (self.times, [(t,) for t in times])):
            state.clear()
            if kept:
                state.put(kept)
        follow = min(x[0] for x in later) if later else max(times) + self.window_us if times else None
        if follow is not None:
            self.handle.registerTimer(max(-(-follow // 1000), watermark + 1))
        if out:
            yield pd.DataFrame(out, columns=["bucket", "event_id", "at", "used", "allowed"])

    def close(self) -> None:
        pass


def limiter(events: DataFrame, window_s: int, limit: int, late: str = "1 day") -> DataFrame:
    """A decision for each event (bucket, event_id, ts) of a stream: allowed while at most ``limit`` events lie in the window that ends with it.

    Events may come in any order and up to ``late`` behind the newest one; each is
    decided when the watermark passes it, so that the decisions are those of the
    whole log in order. Later ones are dropped, as are rows without a bucket or time.
    A bucket's state is what one window and the delay hold, and goes with the
    watermark. The state store has to be one that keeps lists and timers:
    ``spark.sql.streaming.stateStore.providerClass`` names ``STORE``.
    """
    rows = events.where("bucket IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).select("bucket", "event_id", "ts", F.unix_micros("ts").alias("at"))
    told = rows.groupBy("bucket").transformWithStateInPandas(Limiter(window_s * 1_000_000, limit), "bucket string, event_id long, at long, used long, allowed boolean", "Append", "EventTime")
    return told.select("bucket", "event_id", F.timestamp_micros("at").alias("ts"), "used", "allowed")


def throughput(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each type a day, in event time, with a watermark."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(day.alias("day"), "event_type").agg(F.count("*").alias("n")).select(F.col("day.start").alias("day"), "event_type", "n")


def zero_filled(counts: DataFrame, first: str, last: str, types: list[str]) -> DataFrame:
    """Daily counts with a row for every day and type between two dates, from what ``throughput`` has written."""
    spark = counts.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    grid = days.crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in types], "event_type string")))  # days x types
    own = counts.select(F.to_date("day").alias("d"), "event_type", "n")
    return grid.join(own, ["d", "event_type"], "left").select(F.col("d").alias("day"), "event_type", F.coalesce("n", F.lit(0)).alias("n"))


def sweep_step(queue: DataFrame, as_of: str, stalled_s: int, n: int) -> DataFrame:
    """The queue (id, status, started_at, created_at) after one sweep: runs that have stalled wait again, then the n oldest waiting ones run."""
    now = F.lit(as_of).cast("timestamp")
    stalled = (F.col("status") == "RUNNING") & (F.col("started_at") < now - F.make_dt_interval(secs=F.lit(stalled_s)))
    freed = changes.update_where(queue, stalled, status="QUEUED", started_at=F.lit(None).cast("timestamp"))
    return changes.update_join(freed, changes.claim(freed, n, F.asc("created_at"), F.asc("id")), ["id"], status="RUNNING", started_at=now)


def sweep(stream: DataFrame, handle, checkpoint: str, name: str = "sweep"):
    """Work through what is there in micro-batches and stop; ``handle(batch, id)`` must bear repetition."""
    return stream.writeStream.queryName(name).foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
