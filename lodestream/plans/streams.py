"""Stream queries: events are written to the shared folder as files, read as a stream, and the result
of the stream is what SQL finds in the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load, shared_folder
from ..streaming.cumulative import Measure, keep_summary, read_summary
from ..streaming.events import append_files, read_folder, windowed_counts
from ..streaming.stateful import ROCKSDB, circuit_breaker, interval_stream_join
from .registry import query

#: Events of a file.
SEGMENT = 2_000
_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _segments(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """(folder, files): events in files of a stretch of ids each, in a new folder of the shared one."""
    folder = f"{shared_folder(spark)}/lodestream-streams/{uuid.uuid4().hex}"
    events = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    segment = F.floor(F.col("event_id") / SEGMENT)
    events.repartition(segment).write.parquet(f"{folder}/in")
    return folder, len(spark.read.parquet(f"{folder}/in").inputFiles())


def _stream(spark: SparkSession, folder: str, files: int) -> DataFrame:
    """The files as a stream of about four micro-batches."""
    return read_folder(spark, f"{folder}/in", _SCHEMA, files_per_batch=max(1, -(-files // 4)))


@query("stream_append_rows", "SELECT event_id, user_id, event_type FROM events")
def stream_append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended to JSON files, micro-batch by micro-batch, each once."""
    folder, files = _segments(spark, sf_dir)
    rows = _stream(spark, folder, files).select("event_id", "user_id", "event_type")
    append_files(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string").json(f"{folder}/out")


@query("stream_summary", """
SELECT user_id, event_type, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, max(event_id) AS last_id FROM events GROUP BY user_id, event_type""")
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of all rows so far, merged from micro-batch to micro-batch."""
    folder, files = _segments(spark, sf_dir)
    measures = {
        "n": Measure(F.count("*"), F.sum), "least": Measure(F.min("value"), F.min), "most": Measure(F.max("value"), F.max), "last_id": Measure(F.max("event_id"), F.max),
    }
    keep_summary(_stream(spark, folder, files), f"{folder}/summary", f"{folder}/checkpoint", ["user_id", "event_type"], measures).awaitTermination()
    return read_summary(spark, f"{folder}/summary").select("user_id", "event_type", "n", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), "last_id")


@query("stream_windowed_counts", """
WITH w AS (SELECT epoch_ms(ts) // 600000 AS bin, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT bin, event_type, n FROM w""")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute counts of a stream: every change of a window is written with its batch, the last one counts."""
    folder, files = _segments(spark, sf_dir)
    counts = windowed_counts(_stream(spark, folder, files), "ts", "event_type", late="400 days")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    counts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.parquet(f"{folder}/out")
    bin_of = F.floor(F.unix_millis("start") / 600_000)
    return changes.groupBy(bin_of.alias("bin"), "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("stream_circuit_breaker", """
WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY n) AS run FROM o),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type = 'error', run ORDER BY n) AS k FROM r),
s AS (SELECT user_id, min(n) AS stop FROM c WHERE event_type = 'error' AND k >= 2 GROUP BY user_id)
SELECT o.user_id, event_id, stop IS NULL OR n <= stop AS attempted FROM o LEFT JOIN s USING (user_id)""")
def stream_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circuit breaker as a stateful operator: files come in any order, rows are judged as the watermark passes them."""
    folder, files = _segments(spark, sf_dir)
    # a last row far ahead moves the watermark over all others; it has a key of its own
    load(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("ts")).select(
        F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value")
    ).write.mode("append").parquet(f"{folder}/in")
    before = spark.conf.get(ROCKSDB[0])
    spark.conf.set(*ROCKSDB)
    try:
        events = _stream(spark, folder, files + 1).withColumn("failed", F.col("event_type") == "error")
        judged = circuit_breaker(events, "user_id", "ts", "event_id", "failed", late="400 days")
        append = judged.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        append.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ROCKSDB[0], before)
    out = spark.read.parquet(f"{folder}/out").filter("id >= 0")
    return out.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "attempted")


@query("stream_interval_join", """
WITH e AS (SELECT event_id, user_id, event_type, ts FROM events)
SELECT w.event_id AS window_id, p.event_id FROM e w JOIN e p ON w.user_id = p.user_id AND p.ts BETWEEN w.ts AND w.ts + INTERVAL 2 MINUTES
WHERE w.event_type = 'purchase' AND p.event_type <> 'purchase'""")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user did within two minutes after a purchase, from two streams of the same files."""
    folder, files = _segments(spark, sf_dir)
    events = _stream(spark, folder, files)
    purchases = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("window_id"), "user_id", F.col("ts").alias("begin"), (F.col("ts") + F.expr("INTERVAL 2 MINUTES")).alias("end"))
    others = events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    pairs = interval_stream_join(purchases, others, "user_id", "begin", "end", "ts", "2 MINUTES", late="400 days").select("window_id", "event_id")
    append = pairs.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    append.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("window_id long, event_id long").parquet(f"{folder}/out")
