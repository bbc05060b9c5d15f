"""Readers: JSON, JSON lines, CSV, TSV, list files and directories, with explicit schemas.

Nothing is inferred from the data unless asked for, and missing-value spellings become null once, on
reading.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings of a missing value in text tables.
MISSING = ("", "UNKNOWN", "-1")
INDEX_BUCKETS = 64


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Whole JSON documents, one file each; an array gives one row per element."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines without blank ones. ``strict``: a line that isn't an object of the schema fails the
    job with its text; otherwise its fields are null."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if strict:
        parsed = F.from_json("value", _struct(schema), {"mode": "FAILFAST"})
        is_object = F.trim("value").startswith("{")
        value = F.when(is_object, parsed).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))))
    else:
        value = F.from_json("value", _struct(schema))
    return lines.select(value.alias("row")).select("row.*")


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_csv(spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    """Text columns by header, quoted line breaks allowed; ``columns`` names them all and skips inference."""
    reader = spark.read.option("header", True).option("multiLine", True).option("sep", sep).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path, inferSchema=False)


def read_tsv(spark: SparkSession, path: str | list[str], columns: Sequence[str] = ("id", "text")) -> DataFrame:
    return read_csv(spark, path, columns, sep="\t")


def without_sentinels(df: DataFrame, *columns: str, missing: Sequence[str] = MISSING) -> DataFrame:
    """Spellings of a missing value as null."""
    return df.withColumns({c: F.when(~F.col(c).cast("string").isin(*missing), F.col(c)) for c in columns})


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """The first token of every line that is neither blank nor a comment: ``id``."""
    line = F.trim("value")
    kept = spark.read.text(path).filter((line != "") & ~line.startswith("#"))
    return kept.select(F.split(line, r"\s+")[0].alias("id"))


def read_json_maps(spark: SparkSession, path: str, value_type: str = "string") -> DataFrame:
    """All JSON objects of a directory merged to (key, value); a later file, by name, overrides."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"map<string,{value_type}>").alias("m"))
    entries = texts.select("file", F.explode("m").alias("key", "value"))
    return entries.groupBy("key").agg(F.max_by("value", "file").alias("value"))


def list_files(spark: SparkSession, path: str, pattern: str, *fields: tuple[str, int, str]) -> DataFrame:
    """Files below a directory whose path matches, with groups of the pattern as typed columns.

    Only paths are read, not contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    matched = files.filter(F.col("path").rlike(pattern))
    return matched.select("path", "length", *[F.regexp_extract("path", pattern, i).try_cast(kind).alias(name) for name, i, kind in fields])


def media_rows(files: DataFrame, kinds: dict[str, Sequence[str]], skip: Sequence[str] = ()) -> DataFrame:
    """(name, kind, path) of a table of paths: lower-case base name and kind of extension, skipped directories left out."""
    for part in skip:
        files = files.filter(~F.col("path").contains(f"/{part}/"))
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    kind: Column = F.lit(None)
    for name, extensions in kinds.items():
        kind = F.when(F.element_at(F.split(base, "[.]"), -1).isin(*extensions), name).otherwise(kind)
    return files.select(base.alias("name"), kind.alias("kind"), "path").filter("kind is not null")


def media_index(spark: SparkSession, path: str, kinds: dict[str, Sequence[str]], skip: Sequence[str] = ()) -> DataFrame:
    """(name, kind, paths) of the files below a directory; the copies of a name are few, large tables of paths go by ``media_rows``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return media_rows(files, kinds, skip).groupBy("name", "kind").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def read_summaries(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Summary documents found by a path pattern, with the path and the directory's name."""
    found = read_json(spark, pattern, schema).withColumn("path", F.input_file_name())
    return found.withColumn("agent_group", F.element_at(F.split("path", "/"), -2)).withColumn("agent_count", F.size(F.split("agent_group", "_")))


def one_row(df: DataFrame, condition: Column) -> DataFrame:
    """The row that meets a condition; evaluating it fails if there is none or more than one."""
    n = df.filter(condition).agg(F.count("*").alias("n"))
    checked = n.select(F.assert_true(F.col("n") == 1, "exactly one row must match").alias("ok"))
    return df.filter(condition).join(F.broadcast(checked), F.col("ok").isNull()).drop("ok")


def term_bucket(term: Column, buckets: int = INDEX_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def read_index(spark: SparkSession, path: str, terms: Sequence[str], buckets: int = INDEX_BUCKETS) -> DataFrame:
    """Postings of some terms from a saved index: only the folders of their buckets are read."""
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    needed = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(F.transform(wanted, lambda t: term_bucket(t, buckets))))).collect()]
    return spark.read.parquet(path).filter(F.col("bucket").isin(needed) & F.col("term").isin(*terms)).drop("bucket")
