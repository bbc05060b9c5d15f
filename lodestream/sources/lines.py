"""JSON lines with line numbers: a strict reader that names the first bad line, and a lenient one that
returns bad lines as a table.

Files may be split. A task numbers the rows of each split it reads; the lines of a split are counted, and
the counts of the splits before it, a row each, give the number of its first line. Only bad lines meet those
counts, so good rows are parsed where they are read, without a shuffle.

A line is text up to a line end; blank ones count but hold no row. A bad line is one that isn't JSON, one that isn't an
object, and one with a field that doesn't fit the schema. Missing fields are null, unknown ones are left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_JSON, NOT_OBJECT, WRONG_TYPE = "invalid JSON row", "expected JSON object", "a field doesn't fit its type"


class Lines(NamedTuple):
    """``rows`` of the good lines; ``quarantine`` (path, line, reason, text) of the bad ones."""

    rows: DataFrame
    quarantine: DataFrame


class BadLine(ValueError):
    """The first bad line of strictly read files: its message is ``path:line: reason``."""


def _splits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, block, place, value): lines with the split they come from and their order in it."""
    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.text(path).select("value", *where, F.monotonically_increasing_id().alias("place"))


def number_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows of ``lines`` (path, block, place, ...) with their ``line`` in the file, from 1 on."""
    splits = lines.groupBy("path", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    starts = splits.select("path", "block", (before - F.col("first") + 1).alias("shift"))
    return wanted.join(starts, ["path", "block"]).withColumn("line", F.col("place") + F.col("shift")).drop("block", "place", "shift")


def _reason(value: Column, corrupt: Column) -> Column:
    """Why a line is bad; null for a good one."""
    text = F.btrim(value, F.lit(" \t\r"))
    # a second value behind the first makes the array of both valid, but not the line
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    single = whole.isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull() & F.try_parse_json(text).isNotNull()
    is_object = F.startswith(text, F.lit("{"))
    return F.when(~single, NOT_JSON).when(~is_object, NOT_OBJECT).when(corrupt.isNotNull(), WRONG_TYPE)


def read_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> Lines:
    """Lenient: good rows, and a table of bad lines."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsing = T.StructType([*wanted, T.StructField("__bad", T.StringType())])
    lines = _splits(spark, path)
    filled = lines.filter(F.btrim("value", F.lit(" \t\r")) != "")
    options = {"columnNameOfCorruptRecord": "__bad", "allowSingleQuotes": "false"}
    parsed = filled.withColumn("__row", F.from_json("value", parsing, options))
    judged = parsed.withColumn("reason", _reason(F.col("value"), F.col("__row.__bad")))
    rows = judged.filter("reason IS NULL").select(*[F.col("__row")[f.name].alias(f.name) for f in wanted])
    bad = judged.filter("reason IS NOT NULL").select("path", "block", "place", "reason", F.col("value").alias("text"))
    return Lines(rows, number_lines(lines, bad).select("path", "line", "reason", "text"))


def read_lines_strict(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """The rows of all lines; the first bad line, by path and number, is an error that names it."""
    read = read_lines(spark, path, schema)
    first = read.quarantine.select("path", "line", "reason").orderBy("path", "line").limit(1).collect()
    if first:
        raise BadLine("{path}:{line}: {reason}".format(**first[0].asDict()))
    return read.rows
