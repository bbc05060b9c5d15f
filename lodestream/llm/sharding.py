"""Operator 9, sharding: jump consistent hashing of stable keys (native).

Jump consistent hashing (Lamping and Veach, 2014) walks a pseudo-random sequence seeded by the key
and keeps the last jump below the shard count. It needs no ring table, and adding one shard moves
only the rows that land in the new shard. The walk runs here as a fold over 64-bit linear
congruential steps; a step is written in 16/32-bit limbs because SQL integers must not overflow.

Slots number the rows of a shard without gaps. Rows of a shard are first split into hash blocks, so
that no task ever sorts a whole shard; block sizes come from a pass that reads only the key.

Defined results for odd input: a null key hashes like any other single value; a null text has no
bytes; repeated rows share a shard and take different slots; an empty table gives an empty result;
columns of the input named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Multiplier of the published generator, 2862933555777941757, in 32-bit and 16-bit limbs.
MULTIPLIER = 2862933555777941757
_C_LOW0, _C_LOW1 = MULTIPLIER & 0xFFFF, (MULTIPLIER >> 16) & 0xFFFF
_C_HIGH0, _C_HIGH1 = (MULTIPLIER >> 32) & 0xFFFF, (MULTIPLIER >> 48) & 0xFFFF
_MASK = 0xFFFFFFFF

#: Folds longer than this are only evaluated for keys that still need them (about one in 10^30).
SHORT_WALK = 96
RECORD_OVERHEAD = 16


def _step(acc: Column, n_shards: int) -> Column:
    hi, lo = acc["hi"], acc["lo"]
    sum_low = lo * _C_LOW0 + F.lit(1) + F.shiftleft((lo * _C_LOW1).bitwiseAND(F.lit(0xFFFF)), 16)
    low = sum_low.bitwiseAND(F.lit(_MASK))
    high = (
        F.shiftright(sum_low, 32)
        + F.shiftright(lo * _C_LOW1, 16)
        + hi * _C_LOW0
        + F.shiftleft((hi * _C_LOW1).bitwiseAND(F.lit(0xFFFF)), 16)
        + lo * _C_HIGH0
        + F.shiftleft((lo * _C_HIGH1).bitwiseAND(F.lit(0xFFFF)), 16)
    ).bitwiseAND(F.lit(_MASK))
    jump = F.floor((acc["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double")))
    moved = F.struct(high.alias("hi"), low.alias("lo"), acc["j"].alias("b"), jump.cast("long").alias("j"))
    return F.when(acc["j"] < n_shards, moved).otherwise(acc)


def _walk(start: Column, n_shards: int, steps: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda acc, _: _step(acc, n_shards))


def jump_state(hashed: Column, n_shards: int) -> Column:
    """Final state of the walk: ``b`` is the shard among ``n_shards``, ``j`` the next jump."""
    start = F.struct(
        F.shiftrightunsigned(hashed, 32).alias("hi"),
        hashed.bitwiseAND(F.lit(_MASK)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )
    if n_shards <= SHORT_WALK:
        return _walk(start, n_shards, n_shards)
    short = _walk(start, n_shards, SHORT_WALK)
    return F.when(short["j"] >= n_shards, short).otherwise(_walk(start, n_shards, n_shards))


def assign_shards(df: DataFrame, key: str, n_shards: int) -> DataFrame:
    """Add ``shard`` and ``grown_shard``, the shard if there were one more, from ``key`` alone."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    state = df.withColumn("__ls_jump", jump_state(F.xxhash64(F.col(key)), n_shards))
    return (
        state.withColumn("shard", F.col("__ls_jump.b").cast("int"))
        .withColumn("grown_shard", F.when(F.col("__ls_jump.j") == n_shards, F.lit(n_shards)).otherwise(F.col("__ls_jump.b")).cast("int"))
        .drop("__ls_jump")
    )


def number_slots(sharded: DataFrame, key: str, order: list[Column], blocks: int) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each shard, in order of (hash block of the key, ``order``).

    ``blocks`` is the number of hash blocks of a shard. The table of block sizes has shards x blocks
    rows whatever the input, which bounds what is broadcast.
    """
    block = F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(blocks)).cast("int")
    blocked = sharded.withColumn("__ls_block", block)
    sizes = blocked.groupBy("shard", "__ls_block").agg(F.count("*").alias("__ls_n"))
    before = Window.partitionBy("shard").orderBy("__ls_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "shard", "__ls_block", F.coalesce(F.sum("__ls_n").over(before), F.lit(0)).alias("__ls_offset")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "__ls_block").orderBy(*order)).cast("long")
    return (
        blocked.withColumn("__ls_rank", rank - 1)
        .join(F.broadcast(offsets), ["shard", "__ls_block"])
        .withColumn("slot", F.col("__ls_offset") + F.col("__ls_rank"))
        .drop("__ls_block", "__ls_offset", "__ls_rank")
    )


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 40, blocks: int = 1024) -> DataFrame:
    """Shard every row of ``df`` by ``key`` and number it within its shard.

    Adds size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot and grown_shard.
    """
    body = text_or_empty(text).cast("binary")
    sized = (
        df.withColumn("size", F.octet_length(text_or_empty(text)).cast("long") + RECORD_OVERHEAD)
        .withColumn("text_crc32", F.crc32(body))
        .withColumn("law", F.lit("key"))
    )
    sharded = assign_shards(sized, key, n_shards)
    return number_slots(sharded, key, [F.col(key), F.col("text_crc32"), F.col("size")], blocks)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, by the ``key`` law."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    narrow = (
        docs.select(
            "doc_id",
            (F.octet_length(text_or_empty("text")).cast("long") + RECORD_OVERHEAD).alias("size"),
            F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"),
            F.lit("key").alias("law"),
        )
    )
    sharded = assign_shards(narrow, "doc_id", 40)
    numbered = number_slots(sharded, "doc_id", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], 1024)
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
