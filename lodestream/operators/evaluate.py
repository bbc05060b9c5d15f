"""Accuracy and recall summaries: blocks, grouping sets, dense cubes, best-of and differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy_block(trials: DataFrame, by: Sequence[str], correct: str, answered: str) -> DataFrame:
    """(by..., trials, answered, correct, accuracy): correct over all trials, answered or not."""
    return trials.groupBy(*by).agg(*block(correct, answered))


def block(correct: str, answered: str) -> list[Column]:
    n, right = F.count("*"), F.count_if(F.col(correct))
    return [
        n.alias("trials"), F.count_if(F.col(answered)).alias("answered"), right.alias("correct"),
        F.round(right / n, 6).alias("accuracy"),
    ]


def grouping_summary(trials: DataFrame, sets: Sequence[Sequence[str]], columns: Sequence[str], correct: str, answered: str) -> DataFrame:
    """One pass over all groupings; ``grain`` names the columns that a row is grouped by."""
    grouped = trials.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    names = F.array_compact(F.array(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]))
    grain = F.when(F.size(names) == 0, "overall").otherwise(F.array_join(names, "+"))
    return grouped.agg(grain.alias("grain"), *block(correct, answered)).select("grain", *columns, "trials", "answered", "correct", "accuracy")


def dense_cube(trials: DataFrame, a: str, b: str, correct: str, max_values: int = 10_000) -> DataFrame:
    """Every pair of values of two dimensions, with zeros where no trial falls.

    All values of ``b`` are held in one row; evaluating the cube fails if they are more than ``max_values``.
    """
    all_b = trials.agg(F.collect_set(b).alias("__all"), F.count_distinct(b).alias("__n"))
    checked = all_b.select(F.when(F.col("__n") <= max_values, F.col("__all")).otherwise(F.raise_error(F.lit(f"more than {max_values} values of {b}"))).alias("__all"))
    values = trials.select(a).distinct().join(F.broadcast(checked), F.lit(True)).select(a, F.explode("__all").alias(b))
    counted = trials.groupBy(a, b).agg(F.count("*").alias("trials"), F.count_if(F.col(correct)).alias("correct"))
    zero = values.join(counted, [a, b], "left").na.fill(0, ["trials", "correct"])
    return zero.withColumn("accuracy", F.round(F.coalesce(F.try_divide(F.col("correct"), F.col("trials")), F.lit(0.0)), 6))


def best_of(trials: DataFrame, question: str, by: Sequence[str], correct: str, answered: str) -> DataFrame:
    """The oracle's accuracy: a question counts once, as correct if any of its trials is."""
    any_ = trials.groupBy(question, *by).agg(F.bool_or(correct).alias(correct), F.bool_or(answered).alias(answered))
    return any_.groupBy(*by).agg(
        F.count("*").alias("questions"), F.count_if(F.col(answered)).alias("answered"), F.count_if(F.col(correct)).alias("correct"),
        F.round(F.avg(F.col(correct).cast("int")), 6).alias("accuracy"),
    )


def group_label(members: Column, separator: str = "_") -> Column:
    """One name for a set of members, whatever their order."""
    return F.array_join(F.array_sort(F.array_distinct(members)), separator)


def set_recall(found: Column, wanted: Column) -> Column:
    """Share of the wanted members that were found; null if none is wanted."""
    return F.try_divide(F.size(F.array_intersect(found, wanted)), F.size(wanted))


def status_of(done: Column, total: Column) -> Column:
    return F.when(done == 0, "none").when(done == total, "all").otherwise("partial")


def running_mean(rows: DataFrame, by: str, order: str, value: Column, block: int = 1000) -> DataFrame:
    """(by, order, mean): the mean of a value over a group's rows so far, in order of a whole number.

    Rows are summed by blocks of ``block`` numbers, so a task orders one block, or the block sums of one group.
    """
    keyed = rows.select(by, order, value.cast("double").alias("__v"), F.floor(F.col(order) / block).alias("__block"))
    sums = keyed.groupBy(by, "__block").agg(F.sum("__v").alias("__s"), F.count("__v").alias("__n"))
    earlier = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        by, "__block", F.coalesce(F.sum("__s").over(earlier), F.lit(0.0)).alias("__s0"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0")
    )
    upto = Window.partitionBy(by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.withColumn("__s", F.sum("__v").over(upto)).withColumn("__n", F.count("__v").over(upto)).join(offsets, [by, "__block"])
    return placed.select(by, order, ((F.col("__s") + F.col("__s0")) / (F.col("__n") + F.col("__n0"))).alias("mean"))


def exact_median(rows: DataFrame, by: str, value: str, width: float = 1.0) -> DataFrame:
    """(by, median): exact, from a histogram of bins of ``width`` and the different values of the middle
    bins only, so neither a large group nor a frequent value is ordered in one task."""
    keyed = rows.filter(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("__v"), F.floor(F.col(value) / width).alias("__bin"))
    bins = keyed.groupBy(by, "__bin").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(by)))
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    inside = lambda rank: (rank >= F.col("__before")) & (rank < F.col("__before") + F.col("__n"))
    middle = placed.filter(inside(low) | inside(high)).select(by, "__bin", "__before", low.alias("__low"), high.alias("__high"))
    values = keyed.join(middle, [by, "__bin"]).groupBy(by, "__bin", "__before", "__low", "__high", "__v").agg(F.count("*").alias("__n"))
    in_bin = Window.partitionBy(by, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__n").over(in_bin), F.lit(0)))
    at = lambda rank: F.max(F.when(inside(F.col(rank)), F.col("__v")))
    return ranked.groupBy(by).agg(((at("__low") + at("__high")) / 2).alias("median"))
