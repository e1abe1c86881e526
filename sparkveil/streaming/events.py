"""Progress events as a stream, and lockout after failed logins."""

from __future__ import annotations

import threading
import time
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "id long, job_id long, stage string, kind string, message string, payload_json string, event_at timestamp"


def tail(spark: SparkSession, folder: str, schema: str = EVENT) -> DataFrame:
    """Events of an append-only folder as they come."""
    return spark.readStream.schema(schema).parquet(folder)


def follow(events: DataFrame, sink, checkpoint: str, kinds: tuple[str, ...] = ("finished", "failed"), stages: tuple[str, ...] = ("done",), every: str = "500 milliseconds", deadline_s: float = 600.0) -> bool:
    """Hands each batch, ordered by id, to ``sink`` as it comes, until a terminal event (a failure, or a last stage's end) or the deadline.

    True if a terminal event came. The stream goes on over new files until then.
    """
    ended = threading.Event()

    def each(batch: DataFrame, epoch: int) -> None:
        sink(batch.orderBy("id"), epoch)
        over = (F.col("kind") == "failed") | (F.col("kind").isin(*kinds) & F.col("stage").isin(*stages))
        if batch.where(over).take(1):
            ended.set()

    run = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        until = time.monotonic() + deadline_s
        while not ended.wait(0.2) and time.monotonic() < until and run.isActive:
            pass
    finally:
        run.stop()
    if run.exception() is not None:
        raise run.exception()
    return ended.is_set()


def failures_by_window(attempts: DataFrame, minutes: int = 15, slide: int = 1) -> DataFrame:
    """Failures per user and sliding window; late rows count up to one window."""
    return attempts.withWatermark("ts", f"{minutes} minutes").groupBy(F.window("ts", f"{minutes} minutes", f"{slide} minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))


class _Failures(StatefulProcessor):
    """Per user: a map from slices of time to the failures in them, and a timer for each slice, at which it goes."""

    SLICES = 16  # of a window; a count reads whole slices by their size and looks into two

    def __init__(self, limit: int, width: int):
        self.limit, self.width, self.step = limit, width, max(1, width // self.SLICES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slices = handle.getMapState("slices", "slice long", "micros array<long>")

    def _gone_at(self, number: int) -> int:
        """The watermark, in milliseconds, from which no row that is in time can ask for a slice."""
        return ((number + 1) * self.step + self.width) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        new = sorted(int(t) for f in rows for t in f["micros"])
        new = [t for t in new if t >= watermark]  # others are late
        held: dict[int, list[int]] = {}
        there = {k[0] for k in self.slices.keys()} if new else set()  # asked for once: each question to the state is a trip to the JVM

        def at(number: int) -> list[int]:
            if number not in held:
                held[number] = sorted(self.slices.getValue((number,))[0]) if number in there else []
            return held[number]

        for t in new:
            insort(at(t // self.step), t)
        for number in {t // self.step for t in new}:
            self.slices.updateValue((number,), (held[number],))
            self.handle.registerTimer(self._gone_at(number))
        out = []
        for t in new:
            first, last = (t - self.width) // self.step, t // self.step
            n = sum(len(at(i)) for i in range(first + 1, last))
            n += bisect_right(at(last), t) - (bisect_left(at(last), t - self.width) if first == last else 0)
            n += len(at(first)) - bisect_left(at(first), t - self.width) if first < last else 0
            if n >= self.limit:
                out.append((key[0], t, n))
        yield pd.DataFrame(out, columns=["user_id", "micros", "n"]).astype("int64")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number = ((expiredTimerInfo.getExpiryTimeInMs() - 1) * 1000 - self.width) // self.step - 1
        for i in (number, number + 1):  # milliseconds are cut
            if self._gone_at(i) <= expiredTimerInfo.getExpiryTimeInMs() and self.slices.containsKey((i,)):
                self.slices.removeKey((i,))
        yield pd.DataFrame([], columns=["user_id", "micros", "n"]).astype("int64")

    def close(self) -> None:
        pass


def lockouts(attempts: DataFrame, limit: int = 5, minutes: int = 15, late: str = "15 minutes") -> DataFrame:
    """(user_id, micros, n): failures that reach ``limit`` within the trailing window.

    A late row is judged by the times that its window holds, and one beyond the watermark is dropped. State: the user's failures of the
    window before the newest and of the lateness, a slice of time at a time; a slice goes when the watermark has passed it. State is
    kept in RocksDB, which the session is told here.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("user_id", "ts", F.unix_micros(F.col("ts")).alias("micros"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Failures(limit, minutes * 60_000_000), "user_id long, micros long, n long", "Append", "EventTime")
