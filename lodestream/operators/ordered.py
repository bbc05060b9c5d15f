"""Running values over long groups in two levels, so that no task orders a whole group.

Rows are dealt by range of (keys, order) and written; a group may reach into many partitions. Inside a partition a window runs
over the group's rows there; the totals of the group's parts, a row each, are run over in turn and carried in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

PART = "__part"


class Running(NamedTuple):
    """A running value of a column: ``how`` is sum, max, last (the last that isn't null) or total (the sum of the whole
    group); ``current``: with the current row."""

    value: Column
    how: str
    current: bool = True


def stretched(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``rows`` dealt by range of the keys and the order, written, with the number of their partition."""
    place = [F.col(c) if isinstance(c, str) else c for c in (*keys, *order)]
    return checkpointed(rows.repartitionByRange(*place).withColumn(PART, F.spark_partition_id()))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Mapping[str, Running]) -> DataFrame:
    """Add running values to rows that come from ``stretched``; the order must tell the rows of a group apart."""
    inside, parts = Window.partitionBy(*keys, PART).orderBy(*order), Window.partitionBy(*keys).orderBy(PART)
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    own, of_part, carried, merged = {}, {}, {}, {}
    for name, (value, how, current) in values.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow if current else -1)
        here, brought = F.col(f"__own_{name}"), F.col(f"__in_{name}")
        if how in ("sum", "total"):
            of_part[f"__of_{name}"] = F.sum(value)
            carried[f"__in_{name}"] = F.sum(f"__of_{name}").over(earlier if how == "sum" else Window.partitionBy(*keys))
            if how == "sum":
                own[f"__own_{name}"] = F.sum(value).over(frame)
            merged[name] = F.coalesce(here, F.lit(0)) + F.coalesce(brought, F.lit(0)) if how == "sum" else brought
        elif how == "max":
            own[f"__own_{name}"], of_part[f"__of_{name}"] = F.max(value).over(frame), F.max(value)
            carried[f"__in_{name}"] = F.max(f"__of_{name}").over(earlier)
            merged[name] = F.greatest(here, brought)
        elif how == "last":
            place = F.struct(*[F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)])
            own[f"__own_{name}"] = F.last(value, ignorenulls=True).over(frame)
            of_part[f"__of_{name}"] = F.max_by(value, F.when(value.isNotNull(), place))
            carried[f"__in_{name}"] = F.last(f"__of_{name}", ignorenulls=True).over(earlier)
            merged[name] = F.coalesce(here, brought)
        else:
            raise ValueError(f"no such running value: {how}")
    totals = rows.groupBy(*keys, PART).agg(*[v.alias(n) for n, v in of_part.items()]).withColumns(carried)
    totals = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(PART).alias("__k_part"), *carried)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col(PART) == F.col("__k_part"))
    joined = rows.withColumns(own).join(totals, same).withColumns(merged) if own else rows.join(totals, same).withColumns(merged)
    return joined.drop(*own, *carried, *[f"__k_{k}" for k in keys], "__k_part")
