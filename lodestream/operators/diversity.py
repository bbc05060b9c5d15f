"""Greedy selections: each pick depends on the earlier ones, so they run as folds over a bounded
shortlist inside one row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mmr_select(
    scored: DataFrame,
    group: str,
    item: str,
    score: str,
    video: str,
    at: str,
    vector: str,
    k: int,
    relevance: float = 0.7,
    gap: int = 5,
    shortlist: int | None = None,
) -> DataFrame:
    """(group, pick, item): maximal marginal relevance with temporal suppression and back-fill.

    A pick maximises relevance * score - (1 - relevance) * its greatest similarity to earlier picks,
    among items that no earlier pick of the same video lies less than ``gap`` from; a gap of 0 or less
    suppresses nothing. If too few are left, the best scores fill up, suppressed or not. A group
    gathers its ``shortlist`` best, by default the greater of 20 k and 200, so what fills up is the
    best of all candidates.
    """
    shortlist = max(20 * k, 200) if shortlist is None else shortlist
    lam = min(max(relevance, 0.0), 1.0)
    best = Window.partitionBy(group).orderBy(F.desc(score), item)
    short = scored.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= shortlist)
    gathered = short.groupBy(group).agg(
        F.sort_array(
            F.collect_list(
                F.struct(F.col("__n").alias("n"), F.col(item).alias("item"), F.col(score).alias("score"),
                         F.col(video).alias("video"), F.col(at).cast("long").alias("at"), F.col(vector).alias("v"))
            )
        ).alias("items")
    )
    items = F.col("items")

    def step(picked: Column, _: Column) -> Column:
        free = F.filter(
            items,
            lambda c: ~F.exists(picked, lambda p: (p["n"] == c["n"]) | ((p["video"] == c["video"]) & F.lit(gap > 0) & (F.abs(p["at"] - c["at"]) < gap))),
        )
        closest = lambda c: F.coalesce(F.array_max(F.transform(picked, lambda p: dot(p["v"], c["v"]))), F.lit(0.0))
        valued = F.transform(
            free, lambda c: F.struct(F.round(lam * c["score"] - (1 - lam) * closest(c), 6).alias("value"), (-c["n"]).alias("n"))
        )
        return F.when(
            F.size(free) > 0,
            _bind(F.array_max(valued), lambda top: F.concat(picked, F.filter(items, lambda c: c["n"] == -top["n"]))),
        ).otherwise(picked)

    def fill(picked: Column) -> Column:
        left = F.filter(items, lambda c: ~F.exists(picked, lambda p: p["n"] == c["n"]))
        return F.slice(F.concat(picked, left), 1, k)

    empty = F.slice(items, 1, 0)
    chosen = _bind(F.aggregate(F.sequence(F.lit(1), F.lit(k)), empty, step), fill)
    return gathered.select(group, F.posexplode(chosen).alias("pick", "c")).select(
        group, (F.col("pick") + 1).alias("pick"), F.col("c.item").alias(item), F.col("c.score").alias(score)
    )


def spaced_select(rows: DataFrame, group: str, item: str, at: str, day: str, period: str, n: int, spacing: int) -> DataFrame:
    """(group, pick, item): first one row per period, each on a day not used yet, then rows at least
    ``spacing`` from all picks of their day, all in order of (at, item).

    A period's pick is the first row of its day and period, among the first ``n`` such rows of the
    period. A row once too near stays so, hence each later pick is the first free row: one
    aggregate over all rows for each of the ``n`` picks, and nothing else is gathered.
    """
    plain = rows.select(
        F.col(group).alias("g"),
        F.struct(F.col(at).cast("long").alias("at"), F.col(item).alias("item"), F.col(day).cast("long").alias("day"), F.col(period).alias("period")).alias("c"),
    )
    firsts = plain.groupBy("g", F.col("c.day").alias("d"), F.col("c.period").alias("p")).agg(F.min("c").alias("c"))
    by = Window.partitionBy("g", "p").orderBy("c")
    short = firsts.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= n)
    gathered = short.groupBy("g").agg(F.sort_array(F.collect_list("c")).alias("items"))
    items = F.col("items")

    def per_period(picked: Column, c: Column) -> Column:
        clash = F.exists(picked, lambda p: (p["day"] == c["day"]) | (p["period"] == c["period"]))
        return F.when((F.size(picked) < n) & ~clash, F.concat(picked, F.array(c))).otherwise(picked)

    picks = gathered.select("g", F.aggregate(items, F.slice(items, 1, 0), per_period).alias("picked"))
    c, picked = F.col("c"), F.col("picked")
    near = F.exists(
        picked,
        lambda p: ((p["at"] == c["at"]) & (p["item"] == c["item"])) | ((p["day"] == c["day"]) & (F.abs(p["at"] - c["at"]) < spacing)),
    )
    own = plain.withColumnRenamed("g", "h")
    for _ in range(n - 1):  # any group has a first pick
        nearest = picks.join(own, F.col("g").eqNullSafe(F.col("h"))).groupBy("g").agg(F.first("picked").alias("picked"), F.min(F.when((F.size(picked) < n) & ~near, c)).alias("next"))
        picks = nearest.select("g", F.when(F.col("next").isNull(), picked).otherwise(F.concat(picked, F.array("next"))).alias("picked"))
    return picks.select(F.col("g").alias(group), F.posexplode("picked").alias("pick", "c")).select(
        group, (F.col("pick") + 1).alias("pick"), F.col("c.item").alias(item)
    )


def category_pattern_select(rows: DataFrame, item: str, score: str, category: str, pattern: str, n: int) -> DataFrame:
    """(pick, item) over the whole table: unused category and pattern first, then unused category or
    pattern, then any, in three passes by score. Picks of one category and pattern are its best rows, so the
    best ``n`` of each are gathered."""
    by = Window.partitionBy(category, pattern).orderBy(F.desc(score), item)
    short = rows.withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= n)
    gathered = short.groupBy().agg(
        F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(item).alias("item"), F.col(category).alias("c"), F.col(pattern).alias("p")))).alias("items")
    )
    items = F.col("items")

    def pass_(allowed):
        def step(picked: Column, c: Column) -> Column:
            taken = F.exists(picked, lambda p: p["item"] == c["item"])
            used_c = F.exists(picked, lambda p: p["c"].eqNullSafe(c["c"]))
            used_p = F.exists(picked, lambda p: p["p"].eqNullSafe(c["p"]))
            return F.when((F.size(picked) < n) & ~taken & allowed(used_c, used_p), F.concat(picked, F.array(c))).otherwise(picked)

        return step

    picked = F.aggregate(items, F.slice(items, 1, 0), pass_(lambda c, p: ~c & ~p))
    picked = _bind(picked, lambda x: F.aggregate(items, x, pass_(lambda c, p: ~c | ~p)))
    picked = _bind(picked, lambda x: F.aggregate(items, x, pass_(lambda c, p: F.lit(True))))
    return gathered.select(F.posexplode(picked).alias("pick", "c")).select((F.col("pick") + 1).alias("pick"), F.col("c.item").alias(item))
