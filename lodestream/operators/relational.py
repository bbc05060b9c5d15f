"""Joins, merges and reshaping that queries share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of every key in order: an aggregate with map-side combine, no sort."""
    values = [c for c in rows.columns if c not in keys]
    place = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), place).alias("__last"))
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in values])


def merge_prefer_left(left: DataFrame, right: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """All keys of both sides; a value of the left counts unless it is null or empty."""
    l_side = left.select(key, *[F.col(v).alias(f"__l_{v}") for v in values])
    r_side = right.select(key, *[F.col(v).alias(f"__r_{v}") for v in values])
    pick = [F.coalesce(F.nullif(F.col(f"__l_{v}").cast("string"), F.lit("")), F.col(f"__r_{v}").cast("string")).alias(v) for v in values]
    return l_side.join(r_side, key, "full").select(key, *pick)


def priority_lookup(rows: DataFrame, id_col: str, candidates: Column, known: DataFrame, known_key: str, known_value: str) -> DataFrame:
    """(id, found, value): the first candidate key that ``known`` has, else null, else nothing."""
    tried = rows.select(id_col, F.posexplode_outer(candidates).alias("__rank", "__key"))
    hits = tried.join(known.select(F.col(known_key).alias("__key"), F.col(known_value).alias("__value")), "__key", "left")
    best = F.min(F.when(F.col("__value").isNotNull(), F.struct("__rank", F.col("__key").alias("found"), F.col("__value").alias("value"))))
    return hits.groupBy(id_col).agg(best.alias("__best")).select(id_col, F.col("__best.found").alias("found"), F.col("__best.value").alias("value"))


def tagged_union(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    out = None
    for name, df in parts.items():
        own = df.withColumn(tag, F.lit(name))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("nothing to unite")
    return out


def work_list(rows: DataFrame, source: str, order: str) -> DataFrame:
    """(source, first): every different source with the first of its rows."""
    return rows.groupBy(source).agg(F.min(order).alias("first"))
