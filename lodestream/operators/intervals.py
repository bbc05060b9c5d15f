"""Joins and grids over time intervals without nested-loop plans.

A range predicate alone has no equality to hash or sort on. Both sides are therefore put into every
time bin they touch, joined on (keys, bin), and a pair is kept only in the bin where the later of
the two starts, so that it appears once. Bins should be about as long as a typical interval; a very
long one costs a row for each bin it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import PART, Running, running, stretched


def _binned(df: DataFrame, start: str, end: str, bin_ms: int) -> DataFrame:
    """Rows with ``__bin`` for every bin that [start, end] touches; none if a bound is null."""
    first, last = F.floor(F.col(start) / bin_ms), F.floor(F.col(end) / bin_ms)
    return df.filter(F.col(end) >= F.col(start)).withColumn("__bin", F.explode(F.sequence(first, last)))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    bin_ms: int,
    condition: Column,
    start: str = "start_ms",
    end: str = "end_ms",
) -> DataFrame:
    """Pairs of rows with equal keys and touching intervals for which ``condition`` holds.

    Columns of both sides keep their names, so name them apart but for the keys; the intervals are
    l_``start``, l_``end`` and r_``start``, r_``end``.
    """
    l_side = _binned(left.withColumnsRenamed({start: f"l_{start}", end: f"l_{end}"}), f"l_{start}", f"l_{end}", bin_ms)
    r_side = _binned(right.withColumnsRenamed({start: f"r_{start}", end: f"r_{end}"}), f"r_{start}", f"r_{end}", bin_ms)
    later = F.floor(F.greatest(F.col(f"l_{start}"), F.col(f"r_{start}")) / bin_ms)
    return l_side.join(r_side, [*keys, "__bin"]).filter(condition & (F.col("__bin") == later)).drop("__bin")


def strict_overlap(start: str = "start_ms", end: str = "end_ms") -> Column:
    """Half-open intervals share time; touching ends do not."""
    return (F.col(f"l_{start}") < F.col(f"r_{end}")) & (F.col(f"l_{end}") > F.col(f"r_{start}"))


def touching(start: str = "start_ms", end: str = "end_ms") -> Column:
    """Closed intervals share at least an instant."""
    return (F.col(f"l_{start}") <= F.col(f"r_{end}")) & (F.col(f"l_{end}") >= F.col(f"r_{start}"))


def left_inside_right(start: str = "start_ms", end: str = "end_ms") -> Column:
    return (F.col(f"r_{start}") <= F.col(f"l_{start}")) & (F.col(f"r_{end}") >= F.col(f"l_{end}"))


def history_counts(chunks: DataFrame, windows: DataFrame, keys: Sequence[str], end: str, cut: str, window_id: str) -> DataFrame:
    """How many chunks of the same keys ended at or before each window's cut: (window_id, n_history).

    A running count over the merged, ordered ends and cuts in two levels, so no pair of chunk and window is made.
    """
    marks = chunks.select(*keys, F.col(end).alias("at"), F.lit(1).alias("one"), F.lit(None).cast("long").alias(window_id)).unionByName(
        windows.select(*keys, F.col(cut).alias("at"), F.lit(0).alias("one"), F.col(window_id).cast("long").alias(window_id))
    )
    # at equal times chunks come before cuts
    order = ["at", F.desc("one"), window_id]
    counted = running(stretched(marks, keys, ["at"]), keys, order, {"n_history": Running(F.col("one").cast("long"), "sum")})
    return counted.filter(F.col(window_id).isNotNull()).select(window_id, "n_history")


def dense_grid(spans: DataFrame, start: str, end: str, step_ms: int) -> DataFrame:
    """A row for each step from half a step into the span, its midpoint if it is shorter: ``at_ms``."""
    first = F.col(start) + step_ms // 2
    inside = F.when(first < F.col(end), F.sequence(first, F.col(end) - 1, F.lit(step_ms).cast("long")))
    middle = F.array(F.floor((F.col(start) + F.col(end)) / 2).cast("long"))
    return spans.withColumn("at_ms", F.explode(F.array_distinct(F.coalesce(inside, middle))))


def uniform_allocation(spans: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str], n: int) -> DataFrame:
    """n instants spread evenly over the concatenated spans of each key: (keys, i, at_ms, order...).

    Instant i lies at (2i + 1) * total / 2n of the concatenation; integer milliseconds throughout.
    """
    length = F.col(end) - F.col(start)
    place = [start, *order]
    values = {"__before": Running(length, "sum", current=False), "__total": Running(length, "total")}
    run = running(stretched(spans.filter(length > 0), keys, place), keys, place, values).drop(PART)
    # i with before <= floor((2i + 1) * total / 2n) < before + length, found by arithmetic instead of a join
    at = lambda i: F.floor((2 * i + 1) * F.col("__total") / (2 * n)).cast("long")
    candidates = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (at(i) >= F.col("__before")) & (at(i) < F.col("__before") + length))
    return run.withColumn("i", F.explode(candidates)).withColumn("at_ms", F.col(start) + at(F.col("i")) - F.col("__before")).drop("__before", "__total")


def full_bins(intervals: DataFrame, keys: Sequence[str], start: str, end: str, bin_ms: int) -> DataFrame:
    """Bins that an interval covers from end to end: the rows with ``bin`` (its number)."""
    first, last = F.ceil(F.col(start) / bin_ms), F.floor(F.col(end) / bin_ms) - 1
    return intervals.filter(last >= first).withColumn("bin", F.explode(F.sequence(first, last)))
