"""Shared helpers: table access, checkpointing and the word rule."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_array(text: Column) -> Column:
    """Words of a non-null text as an array; an empty array for a blank text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def word_count(text: Column) -> Column:
    """Number of words of a non-null text, as long."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, GAP))).cast("long")


def crc32_mod(col: str, modulus: int) -> Column:
    """crc32 of a value's text form, modulo; a null value counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, which cuts its lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is absent, a local
    session gets a temporary folder; on a cluster, whose executors would not share one, it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestream-checkpoints-"))
    return df.checkpoint(eager=True)


#: Up to so many blocks each has a partition of its own.
KEYED_BLOCKS = 1024


def block_key(spark: SparkSession, number: Column, blocks: int) -> tuple[Column, int]:
    """(key, partitions): a key for the number of a block, and how many partitions to hash it to.

    Up to ``KEYED_BLOCKS`` blocks every one gets a key that hashes to a partition of its own; more are
    dealt eight to a partition on average, which evens their sizes out.
    """
    if blocks > KEYED_BLOCKS:
        return number.cast("int"), -(-blocks // 8)
    tried = spark.range(32 * blocks).select(F.col("id").cast("int").alias("key"))
    keys = tried.groupBy(F.pmod(F.hash("key"), F.lit(blocks)).alias("part")).agg(F.min("key").alias("key"))
    found = {r["part"]: r["key"] for r in keys.collect()}
    free = iter(range(32 * blocks, 33 * blocks))  # a partition that no tried key hashes to shares another's
    return F.get(F.array(*[F.lit(found.get(i) if i in found else next(free)) for i in range(blocks)]), number.cast("int")), blocks


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column that a lambda refers to may be inlined by the optimizer and then evaluated for every
    element; bound as a lambda variable it is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
