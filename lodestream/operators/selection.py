"""Selections under quotas, in stages, evenly spaced or in turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import PART, Running, running, stretched


def quota_with_backfill(rows: DataFrame, category: str, score: str, item: str, n: int) -> DataFrame:
    """n rows by score, at most ceil(n / categories) of a category as long as others can fill up.

    Only the first n rows of each category can be chosen, so those are all that is ordered globally.
    """
    best = Window.partitionBy(category).orderBy(F.desc(score), item)
    short = rows.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= n)
    categories = rows.agg(F.countDistinct(category).alias("k"))
    share = short.join(F.broadcast(categories), F.lit(True)).withColumn("__over", F.col("__n") > F.ceil(F.lit(float(n)) / F.col("k")))
    chosen = share.orderBy("__over", F.desc(score), item).limit(n)
    return chosen.withColumn("n", F.row_number().over(Window.orderBy(F.desc(score), item))).drop("__n", "__over", "k")


def priority_stages(rows: DataFrame, item: str, first: DataFrame, stages: Sequence[tuple[str, Column, Sequence[Column], int]]) -> DataFrame:
    """(item, stage): ``first``, then each stage's best rows that no earlier stage has taken.

    A stage is (name, condition, order, size); sizes bound what is taken and so what is excluded.
    """
    taken = first
    for name, condition, order, size in stages:
        free = rows.filter(condition).join(taken, item, "left_anti")
        taken = taken.unionByName(free.orderBy(*order).limit(size).select(item, F.lit(name).alias("stage")))
    return taken


def even_sample(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """n of each group's m rows at positions round(i (m - 1) / (n - 1)), halves to even; all if there
    are no more than n, the middle one, the later of two, if n is 1."""
    one = F.lit(1).cast("long")
    values = {"__i": Running(one, "sum", current=False), "__m": Running(one, "total")}
    placed = running(stretched(rows, by, order), by, order, values).drop(PART)
    if n == 1:
        return placed.filter(F.col("__i") == F.floor(F.col("__m") / 2)).drop("__i", "__m")
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("__m") - 1) / float(n - 1)).cast("long"))
    return placed.filter((F.col("__m") <= n) | F.array_contains(picks, F.col("__i").cast("long"))).drop("__i", "__m")


def round_robin(rows: DataFrame, source: str, order: Sequence[str], limit: int) -> DataFrame:
    """The first of every source, then the second of every source, up to ``limit``: ``place``."""
    n = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    short = rows.withColumn("__n", n).filter(F.col("__n") <= limit)
    chosen = short.orderBy("__n", source).limit(limit)
    return chosen.withColumn("place", F.row_number().over(Window.orderBy("__n", source))).drop("__n")


def numbered(rows: DataFrame, block: Sequence[Column], order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows from 1 in the order of ``block`` and then ``order``, a column ``name``.

    Rows are counted by block, and only the rows of one block are sorted in a task; blocks are few
    enough to be ordered in one.
    """
    keyed = rows.withColumns({f"__b{i}": c for i, c in enumerate(block)})
    keys = [f"__b{i}" for i in range(len(block))]
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__before", before).drop("__n")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return keyed.withColumn("__place", place).join(counts, keys).withColumn(name, F.col("__before") + F.col("__place")).drop(*keys, "__before", "__place")
