"""State by key for streams: rate limits and silences, kept in value and list state with event-time timers.

Rows that arrive out of order wait until the watermark has passed them, and are then taken in order of their time. So
the results are those of the batch forms for any division of the rows into micro-batches, as long as no row is later than the
watermark's delay. State goes when its timer has run out; what is left for a key is one window and the rows that wait.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What processors return; times are microseconds since 1970, whatever the session's time zone.
DECIDED = "key string, at long, n int, allowed boolean"
SILENT = "project_id long, at long"


def with_rocksdb(spark: SparkSession) -> None:
    """Streams that this session starts from now on keep their state in RocksDB, which timers and list state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def after(micros: int, watermark: int) -> int:
    """A timer in milliseconds for when the watermark has passed a time; one in the past would never run."""
    return max(-(-micros // 1000) + 1, watermark + 1)


def decide(times: Iterable[int], limits: Iterable[int], windows: Iterable[int], start: int | None, n: int) -> tuple[list, list, int | None, int]:
    """Counts in windows that open at a key's first hit after the last window: numbers, verdicts, and the state after them."""
    numbers, verdicts = [], []
    for t, most, length in zip(times, limits, windows, strict=True):
        if start is None or t >= start + length:
            start, n = t, 0
        n += 1
        numbers.append(n)
        verdicts.append(n <= most)
    return numbers, verdicts, start, n


def decided(key: str, times: list[int], numbers: list[int], verdicts: list[bool]) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "at": times, "n": numbers, "allowed": verdicts})


def hits_of(f: pd.DataFrame) -> list[tuple[int, int, int]]:
    """at, most, length (microseconds) of each hit."""
    return list(zip(f["at"].tolist(), f["max"].astype(int).tolist(), (f["window_seconds"].astype(float) * 1e6).round().astype(int).tolist(), strict=True))


class Limiter(StatefulProcessor):
    """Verdicts at once, in order of time within a micro-batch: what a gate in front of a service needs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n int, timer long")

    def keep(self, start: int, n: int, timer: int) -> None:
        if self.window.exists():
            self.handle.deleteTimer(self.window.get()[2])
        self.window.update((start, n, timer))
        self.handle.registerTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A batch's hits of a key may come in several frames, whose times overlap.
        hits = sorted((x for f in rows for x in hits_of(f)), key=lambda x: x[0])
        if hits:
            times, limits, windows = (list(x) for x in zip(*hits, strict=True))
            start, n = self.window.get()[:2] if self.window.exists() else (None, 0)
            numbers, verdicts, start, n = decide(times, limits, windows, start, n)
            self.keep(start, n, after(start + windows[-1], timerValues.getCurrentWatermarkInMs()))
            yield decided(key[0], times, numbers, verdicts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


class OrderedLimiter(StatefulProcessor):
    """Verdicts in order of time over all micro-batches: hits wait until the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, n int, stop long")
        self.waiting = handle.getListState("waiting", "at long, most int, length long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for f in rows:
            hits = hits_of(f)
            if hits:
                self.waiting.appendList(hits)
                for timer in {after(at, watermark) for at, _, _ in hits}:
                    self.handle.registerTimer(timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda x: x[0]) if self.waiting.exists() else []
        ready = [x for x in held if x[0] < watermark * 1000]
        start, n, stop = self.window.get() if self.window.exists() else (None, 0, 0)
        if ready:
            times, limits, windows = (list(x) for x in zip(*ready, strict=True))
            numbers, verdicts, start, n = decide(times, limits, windows, start, n)
            self.window.update((start, n, start + windows[-1]))
            self.handle.registerTimer(after(start + windows[-1], watermark))
            if len(ready) < len(held):
                self.waiting.put(held[len(ready) :])
            else:
                self.waiting.clear()
            yield decided(key[0], times, numbers, verdicts)
        elif start is not None and stop < watermark * 1000 and not held:
            # The window is over and nothing waits: the key's state goes.
            self.window.clear()

    def close(self) -> None:
        pass


class Silence(StatefulProcessor):
    """Silences: a write of a running project that no other write follows for `seconds`. What can still be followed waits."""

    def __init__(self, seconds: int):
        self.length = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.writes = handle.getListState("writes", "at long, running boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for f in rows:
            writes = list(zip(f["at"].tolist(), (f["status"] == "processing").tolist(), strict=True))
            if writes:
                self.writes.appendList(writes)
                for timer in {after(at + self.length, watermark) for at, _ in writes}:
                    self.handle.registerTimer(timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        # Of writes at one time the one that ends the run counts: it comes last.
        held = sorted(self.writes.get(), key=lambda x: (x[0], not x[1])) if self.writes.exists() else []
        ready = [k for k, (at, _) in enumerate(held) if at + self.length < now]
        silent = [held[k][0] for k in ready if held[k][1] and (k + 1 == len(held) or held[k + 1][0] > held[k][0] + self.length)]
        if ready and len(ready) < len(held):
            self.writes.put(held[len(ready) :])
        elif ready:
            self.writes.clear()
        if silent:
            yield pd.DataFrame({"project_id": key[0], "at": silent})

    def close(self) -> None:
        pass


def by_key(rows: DataFrame, key: str, ts: str, delay: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """`processor` on the rows of each key of a stream; a null time or key has no place in event time and is left out."""
    with_rocksdb(rows.sparkSession)
    timed = rows.filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, delay).withColumn("at", F.unix_micros(ts))
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
