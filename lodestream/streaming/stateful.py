"""Stateful stream operators: a circuit breaker for each key, and a join of two streams by time."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, Row, StructField, StructType

#: The state store that stateful processors need; set it on the session before the query starts.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Waiting rows of an entry of the state.
CHUNK = 1_000


def _chunks(rows: list[tuple]) -> Iterator[tuple[list, list, list]]:
    for low in range(0, len(rows), CHUNK):
        yield tuple(map(list, zip(*rows[low : low + CHUNK])))


class _Breaker(StatefulProcessor):
    """After ``limit`` failures in a row nothing more of a key is attempted.

    Rows of a key wait until the watermark has passed them, and are then judged in order of time and id; a timer wakes
    the key at its earliest waiting row. The state of a key is its count of failures with the time of that row, and the
    rows the watermark hasn't reached, in lists of up to ``CHUNK`` rows: what a micro-batch brings is one entry, and they
    are read only when one of them is due.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", StructType([StructField("failures", LongType()), StructField("wakes_ms", LongType())]))
        lists = [StructField("micros", ArrayType(LongType())), StructField("id", ArrayType(LongType())), StructField("failed", ArrayType(BooleanType()))]
        self.waiting = handle.getListState("waiting", StructType(lists))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r["micros"], r["id"], r["failed"]) for r in rows]
        failures, wakes = self.head.get() or (0, None)
        earliest = min(r[0] for r in came) // 1000
        watermark = timerValues.getCurrentWatermarkInMs()
        if min(earliest, earliest if wakes is None else wakes) <= watermark:
            yield from self._judge(key, watermark, came, failures, wakes)
            return
        for chunk in _chunks(came):
            self.waiting.appendValue(chunk)
        if wakes is None or earliest < wakes:
            self._wake(failures, wakes, earliest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        failures, wakes = self.head.get() or (0, None)
        watermark = timerValues.getCurrentWatermarkInMs()
        if wakes is not None and wakes <= watermark:
            yield from self._judge(key, watermark, [], failures, wakes)

    def _judge(self, key, watermark_ms: int, came: list[tuple], n: int, wakes: int | None) -> Iterator[Row]:
        held = came if wakes is None else came + [r for chunk in self.waiting.get() for r in zip(*chunk)]
        held.sort(key=lambda r: r[:2])
        due = bisect_right(held, watermark_ms, key=lambda r: r[0] // 1000)
        for micros, number, failed in held[:due]:
            over = n >= self.limit
            n = n if over else n + 1 if failed else 0
            yield Row(key=key[0], id=number, micros=micros, attempted=not over)
        rest = held[due:]
        if rest:
            self.waiting.put(list(_chunks(rest)))
        elif wakes is not None:
            self.waiting.clear()
        self._wake(n, wakes, rest[0][0] // 1000 if rest else None)

    def _wake(self, failures: int, before: int | None, now: int | None) -> None:
        if before is not None and before != now:
            self.handle.deleteTimer(before)
        if now is not None and before != now:
            self.handle.registerTimer(now)
        self.head.update((failures, now))

    def close(self) -> None:
        pass


def circuit_breaker(events: DataFrame, key: str, ts: str, row_id: str, failed: str, limit: int = 2, late: str = "0 seconds") -> DataFrame:
    """(key, id, ts, attempted) of every row that the watermark has passed, in the order of time and id.

    Rows that come later than ``late`` behind the latest time seen are left out by Spark. A row is given out once
    the watermark has reached it. Needs ``ROCKSDB`` on the session.
    """
    kind = events.schema[key].dataType.simpleString()
    # Spark drops late rows by ts; the operator reads the same time as a number
    rows = events.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("micros"), F.col(row_id).cast("long").alias("id"), F.col(failed).alias("failed"))
    out = f"key {kind}, id long, micros long, attempted boolean"
    judged = rows.groupBy("key").transformWithState(_Breaker(limit), out, "Append", "EventTime")
    return judged.select("key", "id", F.timestamp_micros("micros").alias("ts"), "attempted")


def interval_stream_join(windows: DataFrame, points: DataFrame, key: str, start: str, end: str, ts: str, longest: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of a window and a point of the same key with ``start`` <= ``ts`` <= ``end``, each given out once.

    Both sides have a watermark of ``late``; ``longest`` is the longest a window may be. The time bounds let Spark
    drop a window once no point can fall into it, and a point once no window can reach back to it, so
    state is bounded by time. Columns of the sides keep their names, so name them apart but for ``key``.
    """
    left = windows.withWatermark(start, late).withColumnRenamed(key, "__key").filter(F.col(end) <= F.col(start) + F.expr(f"INTERVAL {longest}"))
    right = points.withWatermark(ts, late)
    inside = (F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end)) & (F.col(ts) <= F.col(start) + F.expr(f"INTERVAL {longest}"))
    return left.join(right, (F.col("__key") == F.col(key)) & inside).drop("__key")
