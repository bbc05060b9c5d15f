"""Structured Streaming forms: windowed counts with late data, deduplication, append sinks and
periodic summaries. These extend the batch queries to unbounded input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_folder(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, ts: str, by: str, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts per window and key; rows later than ``late`` are left out and state is dropped then."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, length), by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of a key, ended by a gap."""
    grouped = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def first_of_key(events: DataFrame, ts: str, keys: list[str], late: str = "30 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def append_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All data there is, row batch by row batch, as JSON lines that are only ever appended."""
    return stream.writeStream.format("json").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summarise_each_batch(stream: DataFrame, summary: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """A summary of every micro-batch in a folder of its own; a batch that is repeated overwrites it."""

    def write(batch: DataFrame, number: int) -> None:
        summary(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
