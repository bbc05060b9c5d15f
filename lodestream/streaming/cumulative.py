"""A summary of all rows so far, kept up by micro-batches and whole after a crash.

The state is a table of mergeable partial results by key. Batch N merges its own partial results with the
snapshot of batch N - 1 and writes them to one of two slots in turn, then names the slot's batch and number of
rows in a manifest. A slot counts only if its rows agree with its manifest, so one that a crash left half
written, or that was overwritten without a new manifest, is passed over; the batch is given again by Spark with the
same rows, finds the snapshot before it untouched, and writes the same result. A batch already in the state is never
added twice.

State grows with the keys, not with the rows; a batch costs its own rows and one read and write of the state.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Measure(NamedTuple):
    """``of`` aggregates rows to a partial result, ``merge`` aggregates partial results of that name."""

    of: Column
    merge: Callable[[str], Column]


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _snapshot(spark: SparkSession, path: str, before: int | None) -> tuple[int, int, DataFrame] | None:
    """The last whole snapshot, of a batch less than ``before`` if that is given: (batch, slot, rows)."""
    found = []
    for slot in (0, 1):
        manifest, rows = _read(spark, f"{path}/manifest/slot={slot}"), _read(spark, f"{path}/state/slot={slot}")
        if manifest is None or rows is None:
            continue
        said = manifest.select("batch", "n_rows").first()
        held = rows.agg(F.count("*"), F.min("batch"), F.max("batch")).first()
        if said is not None and (said["n_rows"], said["batch"], said["batch"]) == tuple(held):
            found.append((said["batch"], slot, rows.drop("batch")))
    found = [f for f in found if before is None or f[0] < before]
    return max(found, key=lambda f: f[0]) if found else None


def merge_batch(batch: DataFrame, number: int, path: str, keys: Sequence[str], measures: Mapping[str, Measure]) -> None:
    """Add one micro-batch to the summary at ``path``."""
    spark = batch.sparkSession
    rows = batch.groupBy(*keys).agg(*[m.of.alias(n) for n, m in measures.items()])
    last = _snapshot(spark, path, number)
    if last is not None:
        rows = last[2].unionByName(rows).groupBy(*keys).agg(*[m.merge(n).alias(n) for n, m in measures.items()])
    slot = number % 2 if last is None else 1 - last[1]
    rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/state/slot={slot}")
    written = spark.read.parquet(f"{path}/state/slot={slot}")
    written.agg(F.lit(number).cast("long").alias("batch"), F.count("*").alias("n_rows")).write.mode("overwrite").parquet(f"{path}/manifest/slot={slot}")


def keep_summary(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], measures: Mapping[str, Measure]) -> StreamingQuery:
    """Summarise all of a stream; start it again with the same folders to go on after a stop or a crash."""

    def write(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path, keys, measures)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary of all finished batches."""
    last = _snapshot(spark, path, None)
    if last is None:
        raise FileNotFoundError(f"no finished batch in {path}")
    return last[2]
