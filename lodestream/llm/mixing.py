"""Operator 7, mixing sources to target weights: Pareto order sampling (native).

Targets: sources share the corpus's size by weight; a target stops at ``max_repeats`` times its
source and the excess is reshared by weight until none is above. That is a water level, found in
closed form from the sources sorted by cap over weight.

Sampling (Rosen, 1997): a source whose target is L times its size takes floor(L) certain whole
copies of every document. The rest of R words is drawn with unequal inclusion probabilities: that of
a document is min(1, c w), where w is its size rounded down to ``SIZE_BITS`` binary digits and c makes
the expected words R. Documents with probability 1 are taken first. The others are ranked by the
odds of a random number over the odds of their probability, and taken in that order as long as they fit
into what is left of R. Behind the first that doesn't fit, documents that are no larger than the rest are
taken in the same order as long as they fit; and two more fill what is left then, the largest document
that fits, of equal ones the first in the order, and the largest that fits after it.

Scale: sizes and random numbers are written once, three numbers a row. c is found from the words of
each rounded size. The order is cut into ``blocks`` blocks per source whose word sums come from an
aggregation with map-side combine, the block at the edge again into as many; whole blocks are
decided by comparison, and only rows of the inner block, one in ``blocks`` squared, are sorted, as
three numbers each. The documents that fill the rest are found by aggregates. Whole rows are then read once
more and decided by their place alone.

Random numbers are hashes of the key columns and a seed, so reruns agree. Name key columns that
tell rows apart; rows equal in all of them and in size are interchangeable, and those at the edge
are sorted in one task; such rows never fill a rest. If all keys are null, all random numbers are
equal, and the order goes by size alone.

Defined results for odd input: null text has size 0 and takes 0 words; a very long text is counted where it is
read, and taken only if it fits or is certain; a null source is a source of its own, ordered last; repeated rows
are sampled one by one; an empty table gives an empty result; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, text_or_empty, word_count

SEED = "lodestream-mix-1"
MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)
#: Up to so many sources their plan is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
SIZE_BITS = 10


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of (source, source_size): one row per source, so a global order over them is small."""
    code_point = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    weighted = (
        sizes.withColumn("__ls_i", F.row_number().over(code_point) - 1)
        .withColumn("weight", F.element_at(cycle, (F.pmod(F.col("__ls_i"), F.lit(len(weights))) + 1).cast("int")).cast("long"))
        .withColumn("__ls_cap", F.col("source_size") * max_repeats)
    )
    by_ratio = Window.orderBy((F.col("__ls_cap") / F.col("weight")).asc(), F.col("__ls_i").asc())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levelled = (
        weighted.withColumn("__ls_total", F.sum("source_size").over(everything))
        .withColumn("__ls_left", F.col("__ls_total") - F.coalesce(F.sum("__ls_cap").over(earlier), F.lit(0)))
        .withColumn("__ls_open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        # a source is below its cap if the level that remains from here on stays under its ratio
        .withColumn("__ls_free", F.col("weight") * F.col("__ls_left") <= F.col("__ls_cap") * F.col("__ls_open"))
    )
    # the level is fixed at the first free source in that order
    ranked = levelled.withColumn("__ls_k", F.row_number().over(by_ratio))
    level = ranked.withColumn(
        "__ls_first", F.min(F.when(F.col("__ls_free"), F.struct("__ls_k", "__ls_left", "__ls_open"))).over(everything)
    )
    share = F.col("weight") * F.col("__ls_first.__ls_left") / F.col("__ls_first.__ls_open")
    target = F.when(F.col("__ls_first").isNull() | (F.col("__ls_k") < F.col("__ls_first.__ls_k")), F.col("__ls_cap").cast("double")).otherwise(share)
    return level.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def rounded_size(size: Column) -> Column:
    """The size with all but its ``SIZE_BITS`` leading binary digits set to zero."""
    shift = F.greatest(F.length(F.bin(size)) - SIZE_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)


def _before(value: str, *order: str | Column) -> Column:
    """Sum of a value over the rows of a source that come earlier."""
    window = Window.partitionBy("__ls_src").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def inclusion_plan(lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: certain copies, the scale c, the largest size that is drawn, and the words
    that are left for drawing. ``lengths`` is (__ls_src, __ls_w, __ls_words) by rounded size."""
    lift = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = targets.select(
        F.col("source").alias("__ls_name"), "source_size", "target", F.floor(lift).alias("__ls_whole"),
        (F.col("target") - F.floor(lift) * F.col("source_size")).alias("__ls_rest"),
    )
    larger = _before("__ls_words", F.desc("__ls_w"))
    from_here = Window.partitionBy("__ls_src").orderBy(F.desc("__ls_w")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    moment = F.sum(F.col("__ls_w").cast("decimal(20,0)") * F.col("__ls_words").cast("decimal(18,0)")).over(from_here)
    sized = lengths.join(planned.select("__ls_name", "__ls_rest"), F.col("__ls_src").eqNullSafe(F.col("__ls_name")))
    scaled = (
        sized.filter("__ls_w > 0")
        .withColumn("__ls_open", F.col("__ls_rest") - larger)
        .withColumn("__ls_scale", F.col("__ls_open") / moment.cast("double"))
        .filter(F.col("__ls_scale") * F.col("__ls_w") < 1)
    )
    edge = scaled.groupBy(F.col("__ls_src").alias("__ls_of")).agg(F.max(F.struct("__ls_w", "__ls_scale", "__ls_open")).alias("e"))
    return planned.join(edge, F.col("__ls_name").eqNullSafe(F.col("__ls_of")), "left").select(
        "__ls_name", "source_size", "target", "__ls_whole",
        F.coalesce("e.__ls_w", F.lit(0)).alias("__ls_top"), F.coalesce("e.__ls_scale", F.lit(0.0)).alias("__ls_scale"),
        F.coalesce("e.__ls_open", F.lit(0.0)).alias("__ls_open"),
    )


def _place(u: Column, w: Column, scale: Column) -> Column:
    """Where a row stands in the order, between 0 and 1: the odds ratio q as q / (1 + q)."""
    p = scale * w
    ratio = (u / (1 - u)) / (p / (1 - p))
    return F.when(p > 0, ratio / (1 + ratio)).otherwise(F.lit(1.0))


def _edges(drawn: DataFrame, plan: DataFrame, block: str, open_: str, edge: str, blocks: int) -> DataFrame:
    """``plan`` with the block in which a source's open words are used up, and what remains for it."""
    sums = drawn.groupBy("__ls_src", block).agg(F.sum("__ls_size").alias("__ls_words"))
    cumulative = sums.withColumn("__ls_before", _before("__ls_words", block)).join(
        plan.select("__ls_name", open_), F.col("__ls_src").eqNullSafe(F.col("__ls_name"))
    )
    at = cumulative.filter((F.col("__ls_before") <= F.col(open_)) & (F.col("__ls_before") + F.col("__ls_words") > F.col(open_)))
    found = at.groupBy(F.col("__ls_src").alias("__ls_of")).agg(F.min(F.struct(F.col(block).alias("b"), (F.col(open_) - F.col("__ls_before")).alias("left"))).alias("e"))
    joined = plan.join(found, F.col("__ls_name").eqNullSafe(F.col("__ls_of")), "left").drop("__ls_of")
    # no edge: every block is before it
    return joined.withColumn(edge, F.coalesce("e.b", F.lit(blocks))).withColumn(f"{edge}_left", F.coalesce("e.left", F.lit(0.0))).drop("e")


def _cuts(core: DataFrame, plan: DataFrame, turn: int) -> DataFrame:
    """``plan`` with the place of the last row taken in the inner block (taken rows come first), how many
    of the rows there are taken if not all are, else 0, and the words that are still left.

    Behind the first turn, rows alike are taken together or not at all."""
    open_ = F.col(f"__ls_core{turn}_left")
    reached = _before("__ls_size", "__ls_place", "__ls_size") + F.col("__ls_size")
    judged = core.select("__ls_src", "__ls_place", "__ls_size", (reached <= open_).alias("__ls_in"))
    places = judged.groupBy("__ls_src", "__ls_place").agg(
        F.count_if("__ls_in").alias("__ls_took"), F.count("*").alias("__ls_n"), F.sum(F.when(F.col("__ls_in"), F.col("__ls_size"))).alias("__ls_words")
    )
    partly = F.col("__ls_took") < F.col("__ls_n")
    places = places.filter("__ls_took > 0") if turn == 1 else places.filter(~partly)
    last = F.max(F.struct("__ls_place", F.when(partly, F.col("__ls_took")).otherwise(0).alias("__ls_tied")))
    cut = places.groupBy(F.col("__ls_src").alias("__ls_of")).agg(last.alias("e"), F.sum("__ls_words").alias("words"))
    joined = plan.join(cut, F.col("__ls_name").eqNullSafe(F.col("__ls_of")), "left")
    named = {f"__ls_cut{turn}": F.coalesce("e.__ls_place", F.lit(-1.0)), f"__ls_left{turn}": open_ - F.coalesce("words", F.lit(0))}
    return joined.withColumns(named | ({"__ls_tied": F.coalesce("e.__ls_tied", F.lit(0))} if turn == 1 else {})).drop("e", "__ls_of", "words")


def _is_fill(n: int) -> Column:
    return (F.col("__ls_size") == F.col(f"__ls_fill{n}")) & (F.col("__ls_place") == F.col(f"__ls_at{n}"))


def _fills(beyond, plan: DataFrame) -> DataFrame:
    """``plan`` with size and place of two rows that fill what is left (__ls_fill1, __ls_at1, ...; size 0: none).

    ``beyond`` gives, for a plan, the rows that aren't taken by their place. A pick with rows alike is given up.
    """
    row = F.struct("__ls_size", (-F.col("__ls_place")).alias("place"))

    def found(plan: DataFrame, n: int, best: Column, alike: Column) -> DataFrame:
        own = beyond(plan).groupBy(F.col("__ls_src").alias("__ls_of")).agg(F.max(best).alias("e"), F.count_if(alike).alias("alike"))
        joined = plan.join(own, F.col("__ls_name").eqNullSafe(F.col("__ls_of")), "left")
        if n > 1:  # the pick before this one
            joined = joined.withColumn(f"__ls_fill{n - 1}", F.when(F.col("alike") == 1, F.col(f"__ls_fill{n - 1}")).otherwise(0))
        if n < 3:
            joined = joined.withColumns({f"__ls_fill{n}": F.coalesce("e.__ls_size", F.lit(0)), f"__ls_at{n}": F.coalesce(-F.col("e.place"), F.lit(-1.0))})
        return checkpointed(joined.drop("e", "alike", "__ls_of"))

    size, left = F.col("__ls_size"), F.col("__ls_left2")
    plan = found(plan, 1, F.when(size <= left, row), F.lit(False))
    plan = found(plan, 2, F.when(~_is_fill(1) & (size <= left - F.col("__ls_fill1")), row), _is_fill(1))
    return found(plan, 3, F.when(F.lit(False), row), _is_fill(2))


def mix(
    df: DataFrame,
    size: str,
    source: str = "source",
    keys: Sequence[str] = ("doc_id",),
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    blocks: int = 2048,
    seed: str = SEED,
) -> DataFrame:
    """Add source_size, target, copies and taken to every row of ``df``.

    ``size`` names a column of non-negative longs. Nothing is dropped: rows the mix leaves out have
    0 copies.
    """
    keyed = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in keys])
    uniform = (F.conv(F.substring(F.md5(keyed), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    drawn = df.withColumns({"__ls_u": uniform, "__ls_src": F.col(source), "__ls_size": F.col(size).cast("long")})
    drawn = drawn.withColumn("__ls_w", rounded_size(F.col("__ls_size")))
    slim = checkpointed(drawn.select("__ls_src", "__ls_u", "__ls_size", "__ls_w"))
    lengths = checkpointed(slim.groupBy("__ls_src", "__ls_w").agg(F.sum("__ls_size").alias("__ls_words")))
    sizes = lengths.groupBy(F.col("__ls_src").alias("source")).agg(F.sum("__ls_words").alias("source_size"))
    plan = checkpointed(inclusion_plan(lengths, source_targets(sizes, weights, max_repeats)))
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES

    def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
        side = F.broadcast(plan) if few else plan
        joined = rows.join(side, F.col("__ls_src").eqNullSafe(F.col("__ls_name")))
        place = joined.withColumn("__ls_place", _place(F.col("__ls_u"), F.col("__ls_w"), F.col("__ls_scale")))
        outer = F.least(F.floor(F.col("__ls_place") * blocks), F.lit(blocks - 1))
        inner = F.least(F.floor((F.col("__ls_place") * blocks - outer) * blocks), F.lit(blocks - 1))
        return place.withColumn("__ls_outer", outer).withColumn("__ls_inner", inner)

    def take(plan: DataFrame, turn: int, of: Column, open_: str) -> tuple[DataFrame, Column, Column]:
        """``plan`` with the edges of a turn, its rows in the inner block, and the rows that it takes."""
        plan = checkpointed(_edges(with_plan(slim, plan).filter(of), plan, "__ls_outer", open_, f"__ls_edge{turn}", blocks))
        outer = F.col("__ls_outer") - F.col(f"__ls_edge{turn}")
        plan = checkpointed(_edges(with_plan(slim, plan).filter(of & (outer == 0)), plan, "__ls_inner", f"__ls_edge{turn}_left", f"__ls_core{turn}", blocks))
        inner = F.col("__ls_inner") - F.col(f"__ls_core{turn}")
        core = of & (outer == 0) & (inner == 0)
        plan = checkpointed(_cuts(with_plan(slim, plan).filter(core), plan, turn))
        before = (outer < 0) | ((outer == 0) & (inner < 0))
        return plan, core, of & (before | (core & (F.col("__ls_place") <= F.col(f"__ls_cut{turn}"))))

    free = (F.col("__ls_open") > 0) & (F.col("__ls_w") > 0) & (F.col("__ls_w") <= F.col("__ls_top"))
    plan, core, first = take(plan, 1, free, "__ls_open")
    plan, _, second = take(plan, 2, free & ~first & (F.col("__ls_size") <= F.col("__ls_left1")), "__ls_left1")
    rest = free & ~first & ~second
    plan = _fills(lambda p: with_plan(slim, p).filter(rest & (F.col("__ls_size") <= F.col("__ls_left2"))), plan)

    joined = with_plan(drawn.drop("source_size", "target"), plan)
    certain = (F.col("__ls_open") > 0) & (F.col("__ls_w") > 0) & (F.col("__ls_w") > F.col("__ls_top"))
    more = certain | first | second | (rest & (_is_fill(1) | _is_fill(2)))
    marked = joined.withColumn("__ls_more", more.cast("long"))
    if not plan.filter("__ls_tied > 0").isEmpty():  # of rows alike at the cut some are taken
        at_cut = core & (F.col("__ls_tied") > 0) & (F.col("__ls_place") == F.col("__ls_cut1"))
        number = F.row_number().over(Window.partitionBy("__ls_src").orderBy(*keys, "__ls_size"))
        alike = marked.filter(at_cut).withColumn("__ls_more", (number <= F.col("__ls_tied")).cast("long"))
        marked = marked.filter(~at_cut).unionByName(alike)
    return (
        marked.withColumn("copies", (F.col("__ls_whole") + F.col("__ls_more")).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("__ls_size"))
        .drop(*[c for c in marked.columns if c.startswith("__ls_")])
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; sizes are words, computed once and checkpointed."""
    docs = table(spark, sf_dir, "documents")
    sized = checkpointed(docs.select("doc_id", "source", word_count(text_or_empty("text")).alias("size")))
    return mix(sized, "size").select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('lodestream-mix-1|' || coalesce(doc_id::VARCHAR, '\N')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i FROM s),
x AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, i) AS k,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS open
  FROM x),
f AS (SELECT k AS fk, rest AS frest, open AS fopen FROM o WHERE weight * rest <= cap * open ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN fk IS NULL OR k < fk THEN cap::DOUBLE ELSE (weight * frest)::DOUBLE / fopen::DOUBLE END AS target
  FROM o LEFT JOIN f ON TRUE),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
v AS (SELECT *, (size >> greatest(length(bin(size)) - 10, 0)::INTEGER) << greatest(length(bin(size)) - 10, 0)::INTEGER AS w FROM d),
g AS (SELECT source, w, sum(size)::BIGINT AS words FROM v WHERE w > 0 GROUP BY source, w),
h AS (SELECT g.source, w,
    target - whole * source_size - coalesce(sum(words) OVER (PARTITION BY g.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_over,
    (sum(w::HUGEINT * words) OVER (PARTITION BY g.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS moment
  FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, max(w) AS top, arg_max(left_over, w) AS left_over, arg_max(left_over / moment, w) AS scale FROM h WHERE left_over / moment * w < 1 GROUP BY source),
r AS (SELECT v.doc_id, v.size, v.source, v.w, p.source_size, p.target, p.whole, e.top, e.left_over,
    v.w > 0 AND v.w <= e.top AS free,
    CASE WHEN e.scale * v.w > 0 THEN (u / (1 - u)) / (e.scale * v.w / (1 - e.scale * v.w)) END AS ratio
  FROM v JOIN p ON v.source IS NOT DISTINCT FROM p.source LEFT JOIN e ON v.source IS NOT DISTINCT FROM e.source),
q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, free ORDER BY coalesce(ratio / (1 + ratio), 1), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM r),
z AS (SELECT *, coalesce(ratio / (1 + ratio), 1) AS place, free AND left_over > 0 AND reached + size <= left_over AS fits FROM q),
l AS (SELECT source, any_value(left_over) - coalesce(sum(size) FILTER (WHERE fits), 0) AS rest1 FROM z WHERE free AND left_over > 0 GROUP BY source),
z2 AS (SELECT z.*, rest1, free AND left_over > 0 AND NOT fits AND size <= rest1 AS small FROM z LEFT JOIN l ON z.source IS NOT DISTINCT FROM l.source),
y2 AS (SELECT *, coalesce(small AND sum(size) OVER (PARTITION BY source, small ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest1, false) AS fits2 FROM z2),
l2 AS (SELECT source, any_value(rest1) - coalesce(sum(size) FILTER (WHERE fits2), 0) AS rest FROM y2 WHERE free AND left_over > 0 GROUP BY source
  HAVING bool_or(small AND NOT fits2)),
b AS (SELECT y2.*, rest FROM y2 JOIN l2 ON y2.source IS NOT DISTINCT FROM l2.source WHERE free AND left_over > 0 AND NOT fits AND NOT fits2),
f1 AS (SELECT source, arg_max({'d': doc_id, 's': size}, (size, -place)) AS x FROM b WHERE size <= rest GROUP BY source),
f2 AS (SELECT b.source, arg_max(doc_id, (size, -place)) AS y FROM b JOIN f1 ON b.source IS NOT DISTINCT FROM f1.source WHERE size <= rest - x.s AND doc_id <> x.d GROUP BY b.source),
m AS (SELECT y2.*, (whole + CASE WHEN left_over > 0 AND w > 0 AND (w > top OR fits OR fits2 OR coalesce(doc_id = x.d, false) OR coalesce(doc_id = y, false)) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM y2 LEFT JOIN f1 ON y2.source IS NOT DISTINCT FROM f1.source LEFT JOIN f2 ON y2.source IS NOT DISTINCT FROM f2.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM m
"""
