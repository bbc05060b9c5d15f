"""Mergeable sketches beside the exact aggregates: distinct counts (HLL) and quantiles (KLL) kept as columns.

States of a fine grain are a table; any coarser grain, grouping sets among them, merges states and never reads the rows again. With
2^12 registers a distinct count is off by 1.6 % (one standard deviation), with k = 200 a quantile by about 1.3 % in rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sketch_states(rows: DataFrame, keys: Sequence[str], distinct: str, value: str) -> DataFrame:
    """(keys, n, distinct_state, value_state) of every group."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(distinct).alias("distinct_state"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("value_state")
    )


def merge_states(states: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """States over grouping sets of the keys; a key that a set leaves out is null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = states.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_state").alias("distinct_state"), F.kll_merge_agg_double("value_state").alias("value_state"), F.grouping_id().alias("grain")
    )


def estimates(states: DataFrame, quantile: float) -> DataFrame:
    """States with ``n_distinct`` and the value at a quantile, ``at_quantile``."""
    return states.withColumns({
        "n_distinct": F.hll_sketch_estimate("distinct_state"), "at_quantile": F.kll_sketch_get_quantile_double("value_state", F.lit(quantile)),
    }).drop("distinct_state", "value_state")
