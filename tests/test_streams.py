"""Streams that stop and go on, and late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestream.streaming import cumulative as cu
from lodestream.streaming.events import read_folder
from lodestream.streaming.stateful import ROCKSDB, _Breaker, circuit_breaker, interval_stream_join

SCHEMA = "k long, v long"
def measures():
    return {"n": cu.Measure(F.count("*"), F.sum), "total": cu.Measure(F.sum("v"), F.sum), "top": cu.Measure(F.max("v"), F.max)}


def write_files(spark, folder, parts):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def summary(spark, path):
    return {r["k"]: (r["n"], r["total"], r["top"]) for r in cu.read_summary(spark, path).collect()}


def expected(parts):
    out = {}
    for k, v in [r for p in parts for r in p]:
        n, total, top = out.get(k, (0, 0, v))
        out[k] = (n + 1, total + v, max(top, v))
    return out


@pytest.mark.parametrize("crash", ["before the state", "behind the state", "half a state"])
def test_summary_after_a_crash(spark, tmp_path, monkeypatch, crash):
    """A batch that fails at any point is given again and counted once."""
    parts = [[(k, 10 * f + k) for k in range(f, f + 3)] for f in range(6)]
    write_files(spark, f"{tmp_path}/in", parts)
    start = lambda: cu.keep_summary(read_folder(spark, f"{tmp_path}/in", SCHEMA), f"{tmp_path}/out", f"{tmp_path}/cp", ["k"], measures())
    real = cu.merge_batch

    def failing(batch, number, path, keys, measures):
        if number == 3 and crash == "before the state":
            raise RuntimeError("killed")
        real(batch, number, path, keys, measures)
        if number == 3 and crash == "behind the state":
            raise RuntimeError("killed")
        if number == 3:  # the slot has some rows of the new batch, and the manifest is still that of the one before
            slot = next(s for s in (0, 1) if spark.read.parquet(f"{path}/state/slot={s}").first()["batch"] == 3)
            spark.createDataFrame([(1, 1, 1, 1, 3)], "k long, n long, total long, top long, batch long").write.mode("overwrite").parquet(f"{path}/state/slot={slot}")
            spark.createDataFrame([(1, 99)], "batch long, n_rows long").write.mode("overwrite").parquet(f"{path}/manifest/slot={slot}")
            raise RuntimeError("killed")

    monkeypatch.setattr(cu, "merge_batch", failing)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    assert sum(n for n, _, _ in summary(spark, f"{tmp_path}/out").values()) == (12 if crash == "behind the state" else 9)
    monkeypatch.setattr(cu, "merge_batch", real)
    start().awaitTermination()
    assert summary(spark, f"{tmp_path}/out") == expected(parts)
    more = [[(1, 500)], [(70, 1)]]
    write_files(spark, f"{tmp_path}/in", more)
    start().awaitTermination()
    assert summary(spark, f"{tmp_path}/out") == expected(parts + more)


def test_no_summary_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        cu.read_summary(spark, f"{tmp_path}/none")


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


EVENTS = "key long, ts timestamp, id long, failed boolean"


def run_breaker(spark, tmp_path, files, late):
    spark.conf.set(*ROCKSDB)
    try:
        for i, rows in enumerate(files):
            spark.createDataFrame([(k, at(s), i, f) for k, s, i, f in rows], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            # one run for every file: state, timers and the watermark go on from the checkpoint
            events = read_folder(spark, f"{tmp_path}/in", EVENTS)
            query = circuit_breaker(events, "key", "ts", "id", "failed", late=late).writeStream.format("parquet").outputMode("append")
            query.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(ROCKSDB[0])
    return {(r["key"], r["id"]): r["attempted"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_breaker_over_restarts_and_late_rows(spark, tmp_path):
    files = [
        [(1, 10, 1, True), (1, 30, 3, True), (2, 10, 1, True), (2, 20, 2, False)],
        [(1, 20, 2, False), (1, 40, 4, True), (2, 30, 3, True)],  # id 2 of key 1 comes out of order, within the delay
        [(1, 200, 5, False), (2, 210, 4, True), (2, 220, 5, True)],
        [(1, 50, 9, False), (3, 230, 1, True)],  # id 9 is behind the watermark
        [(9, 900, 1, False)],
        [(9, 2000, 2, False)],
    ]
    got = run_breaker(spark, tmp_path, files, "60 seconds")
    want = {(1, 1): True, (1, 2): True, (1, 3): True, (1, 4): True, (1, 5): False, (2, 1): True, (2, 2): True, (2, 3): True, (2, 4): True, (2, 5): False, (3, 1): True}
    assert {k: v for k, v in got.items() if k[0] < 9} == want


class _Counted:
    """A state of a key that counts its calls."""

    def __init__(self):
        self.values, self.calls = [], {}

    def __getattr__(self, name):
        def call(*args):
            self.calls[name] = self.calls.get(name, 0) + 1
            if name == "appendValue":
                self.values.append(args[0])
            elif name in ("put", "update"):
                self.values = list(args[0]) if name == "put" else [args[0]]
            elif name == "clear":
                self.values = []
            elif name == "exists":
                return bool(self.values)
            elif name == "listTimers":
                return []

        return call


class _Value(_Counted):
    def get(self):
        return self.values[0] if self.values else None


class _List(_Counted):
    def get(self):
        self.calls["get"] = self.calls.get("get", 0) + 1
        return iter(list(self.values))


def test_waiting_rows_are_few_entries_and_read_once():
    """A micro-batch's rows of a key are one entry; entries are read when the watermark reaches the earliest."""
    value, waiting, handle, clock = _Value(), _List(), _Counted(), _Counted()
    handle.getValueState, handle.getListState = lambda *_: value, lambda *_: waiting
    now = [0]
    clock.getCurrentWatermarkInMs = lambda: now[0]
    breaker = _Breaker(2)
    breaker.init(handle)
    rows = [{"ts": at(s), "micros": int(s * 1e6) + 1_000_000, "id": s, "failed": s in (40, 41)} for s in range(2_000)]
    for low in (1_000, 0, 1_500, 500):
        assert list(breaker.handleInputRows((7,), iter(rows[low : low + 500]), clock)) == []
    assert waiting.calls == {"appendValue": 4}
    now[0] = 1_999_000
    first = list(breaker.handleExpiredTimer((7,), clock, None))
    now[0] = 10**9
    last = list(breaker.handleExpiredTimer((7,), clock, None))
    assert len(first) == 1_999 and [r["id"] for r in first + last] == list(range(2_000))
    assert [r["attempted"] for r in first + last] == [i <= 41 for i in range(2_000)]
    assert waiting.calls["get"] == 2 and not waiting.values


def test_interval_join_drops_state(spark, tmp_path):
    w, p = "window_id long, user_id long, begin timestamp, end timestamp", "event_id long, user_id long, ts timestamp"
    query = None
    for low in range(0, 4000, 1000):
        spark.createDataFrame([(low + i, i % 3, at(low + 10 * i), at(low + 10 * i + 60)) for i in range(20)], w).coalesce(1).write.mode("append").parquet(f"{tmp_path}/w")
        spark.createDataFrame([(low + i, i % 3, at(low + 7 * i)) for i in range(40)], p).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
        pairs = interval_stream_join(read_folder(spark, f"{tmp_path}/w", w), read_folder(spark, f"{tmp_path}/p", p), "user_id", "begin", "end", "ts", "60 SECONDS", late="30 seconds")
        query = pairs.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    windows, points = spark.read.parquet(f"{tmp_path}/w"), spark.read.parquet(f"{tmp_path}/p")
    want = windows.join(points, "user_id").filter("ts BETWEEN begin AND end").select("window_id", "event_id")
    got = spark.read.parquet(f"{tmp_path}/out").select("window_id", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rows = [s["numRowsTotal"] for s in query.lastProgress["stateOperators"]]
    assert sum(rows) < windows.count() + points.count()
