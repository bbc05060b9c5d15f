"""Parquet tables and the derived views that queries share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefns import day_number, millis_of_day


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``; a local session may
    do without, and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lodestream-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def contents_key(spark: SparkSession, folder: str, name: str) -> str:
    """A key of a table's files, by path, length and time; their contents aren't read."""
    files = spark.read.format("binaryFile").load(f"{folder}/{name}.parquet")
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    n, total = files.agg(F.count("*"), F.sum(each)).first()
    return f"{name}-{n}-{total}"


def events_as_intervals(spark: SparkSession, folder: str, span_ms: int = 30_000) -> DataFrame:
    """Events as intervals of ``span_ms``: integer milliseconds since 1970, and the day number."""
    events = load(spark, folder, "events")
    start = day_number("ts") * 86_400_000 + millis_of_day("ts")
    return events.select(
        "event_id", "user_id", "event_type", "value",
        day_number("ts").alias("day"),
        millis_of_day("ts").alias("sod_ms"),
        start.alias("start_ms"),
        (start + span_ms).alias("end_ms"),
    )


def purchase_windows(spark: SparkSession, folder: str, margin_ms: int = 120_000) -> DataFrame:
    """Context windows: purchases widened by a margin on both sides."""
    purchases = events_as_intervals(spark, folder).filter(F.col("event_type") == "purchase")
    return purchases.select(
        F.col("event_id").alias("window_id"), "user_id", "day",
        F.col("start_ms").alias("core_ms"),
        (F.col("start_ms") - margin_ms).alias("start_ms"),
        (F.col("start_ms") + margin_ms).alias("end_ms"),
    )
