"""The token bucket as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from promptveil.functions.times import micros_of
from promptveil.operators.token_bucket import Rate, outcome_columns

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BucketProcessor(StatefulProcessor):
    """Two numbers per user. Without ``idle`` they are kept for good; with it a timer in event time drops a bucket when it
    must be full again, which is what a user without one starts with. (A clean-up by the wall clock could drop a bucket
    that is not full yet in event time when a replay is slow.)"""

    def __init__(self, rate: Rate, idle: bool = False):
        self.rate, self.idle = rate, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "left bigint, micros bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["micros", "event_id"])
        left, last = self.bucket.get() if self.bucket.exists() else (self.rate.full, int(arrived["micros"].iloc[0]))
        offers = []
        for now in arrived["micros"].tolist():
            offered = self.rate.offered(left, now - last)
            left, last = self.rate.after(offered), now
            offers.append(offered)
        self.bucket.update((left, last))
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            full_at = last - (left - self.rate.full) // self.rate.per_micro  # the division rounds the wait up
            self.handle.registerTimer(full_at // 1000 + 1)
        yield arrived.assign(offered=offers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        return iter([])

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame, capacity: int, refill_per_sec: float, user: str = "user_id", ts: str = "ts",
                  event_id: str = "event_id", carry: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """The batch replay's columns for a stream, and the columns named in ``carry`` (of plain types). Rows are taken in
    (ts, event_id) order within a micro-batch; a row that comes in a later micro-batch than its time is metered on arrival,
    with no refill for the clock going back.

    ``late`` (such as "1 hour") drops the state of users whose bucket is full again, ``late`` behind the newest time seen.
    Results are the same, but Spark then leaves out rows that come later than that: give it only where none does."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rate = Rate.of(capacity, refill_per_sec)
    moments = events.select(F.col(event_id).alias("event_id"), F.col(user).alias("user_id"), F.col(ts).alias("ts"),
                            *carry, micros_of(events, ts).alias("micros"))
    if late is not None:
        moments = moments.withWatermark("ts", late)
    metered = moments.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=BucketProcessor(rate, late is not None),
        outputStructType=moments.withColumn("offered", F.lit(0).cast("bigint")).schema,
        outputMode="append", timeMode="None" if late is None else "EventTime")
    out = metered.withColumns(outcome_columns(F.col("offered"), rate)).drop("micros", "offered")
    return out.withColumnsRenamed({"event_id": event_id, "user_id": user, "ts": ts})
