"""Decision lists and flags: ordered rules folded into one expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def decision_list(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(default)
    for condition, label in reversed(rules):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def true_labels(flags: Mapping[str, Column]) -> Column:
    """Names of the flags that hold, in order, as an array."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags.items()]))


def reasons(parts: Sequence[tuple[Column, str | Column]], separator: str = " | ") -> Column:
    """Fragments of the conditions that hold, joined in order."""
    chosen = [F.when(c, F.lit(text) if isinstance(text, str) else text) for c, text in parts]
    return F.array_join(F.array_compact(F.array(*chosen)), separator)


def best_option(values: Mapping[str, Column]) -> Column:
    """Name of the greatest value; ties go to the first named, nulls never win."""
    ordered = [
        F.when(v.isNotNull(), F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")))
        for i, (k, v) in enumerate(values.items())
    ]
    return F.greatest(*ordered)["k"] if len(ordered) > 1 else ordered[0]["k"]
