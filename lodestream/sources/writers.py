"""Writers: CSV with fixed columns, JSON lines, nested rows as flat CSV, index tables, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import INDEX_BUCKETS, term_bucket


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "overwrite") -> None:
    """The named columns as text, in order; others are left out, missing ones are empty, line breaks
    are written as ``\\n``."""
    text = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"), F.lit("\\n"))
    chosen = [text(c).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*chosen).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def flat_columns(paths: Mapping[str, str], df: DataFrame) -> list[Column]:
    """Dotted paths of nested columns as text: arrays joined by ``;``, structs and maps as JSON."""
    out = []
    for name, path in paths.items():
        kind = df.select(F.col(path)).schema[0].dataType.typeName()
        value = F.col(path)
        if kind == "array":
            value = F.array_join(value.cast("array<string>"), ";")
        elif kind in ("struct", "map", "variant"):
            value = F.to_json(value)
        out.append(F.coalesce(value.cast("string"), F.lit("")).alias(name))
    return out


def write_flat_csv(df: DataFrame, path: str, paths: Mapping[str, str]) -> None:
    flat = df.select(*flat_columns(paths, df))
    write_csv(flat, path, list(paths))


def write_index(postings: DataFrame, path: str, term: str = "term", buckets: int = INDEX_BUCKETS) -> None:
    """Postings as Parquet by hash bucket of the term, so that a few terms read a few files."""
    bucketed = postings.withColumn("bucket", term_bucket(F.col(term), buckets))
    bucketed.repartition("bucket").sortWithinPartitions(term).write.mode("overwrite").partitionBy("bucket").parquet(path)


def html_table(df: DataFrame, title: str = "", limit: int = 100) -> str:
    """The first rows as an HTML page with one table; texts are escaped."""
    from html import escape

    cells = lambda tag, values: "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in values)
    rows = "\n".join(f"<tr>{cells('td', r)}</tr>" for r in df.limit(limit).collect())
    return f"<!doctype html>\n<title>{escape(title)}</title>\n<table>\n<tr>{cells('th', df.columns)}</tr>\n{rows}\n</table>\n"


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """The first rows as a Markdown table; a report is for people, so it is short by design."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
