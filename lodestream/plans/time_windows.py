"""Interval and time-window queries over events read as 30-second clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timefns as tm
from ..operators import intervals as iv
from ..operators.ordered import Running, running, stretched
from ..sources.tables import events_as_intervals, load, purchase_windows
from .registry import query

BIN_MS = 600_000
#: Bins of a join of all pairs, and the clips of its parts; seven times as many ids stay below a dictionary page of 1 MB.
PAIR_BIN_MS = 30_000
PART_CLIPS = 12_000

_CLIPS = """
WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) // 1000 % 86400000 AS sod_ms,
  epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 30000 AS end_ms FROM events),
w AS (SELECT event_id AS window_id, user_id, day, start_ms AS core_ms, start_ms - 120000 AS w_start, start_ms + 120000 AS w_end FROM e WHERE event_type = 'purchase')
"""


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_intervals(spark, sf_dir)


@query("interval_overlap_join", _CLIPS + """
SELECT window_id, event_id, greatest(w_start, start_ms) - w_start AS local_start, least(w_end, end_ms) - greatest(w_start, start_ms) AS duration
FROM w JOIN e ON w.user_id = e.user_id WHERE start_ms < w_end AND end_ms > w_start""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that share time with a window of the same user, clipped to it."""
    windows = purchase_windows(spark, sf_dir).select("window_id", "user_id", "start_ms", "end_ms")
    clips = _clips(spark, sf_dir).select("event_id", "user_id", "start_ms", "end_ms")
    pairs = iv.interval_join(windows, clips, ["user_id"], BIN_MS, iv.strict_overlap())
    begin, end = F.greatest("l_start_ms", "r_start_ms"), F.least("l_end_ms", "r_end_ms")
    return pairs.select("window_id", "event_id", (begin - F.col("l_start_ms")).alias("local_start"), (end - begin).alias("duration"))


@query("interval_containment_join", _CLIPS + """
SELECT window_id, event_id FROM w JOIN e ON w.user_id = e.user_id WHERE start_ms >= w_start AND end_ms <= w_end""")
def interval_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that lie wholly inside a window of the same user."""
    clips = _clips(spark, sf_dir).select("event_id", "user_id", "start_ms", "end_ms")
    windows = purchase_windows(spark, sf_dir).select("window_id", "user_id", "start_ms", "end_ms")
    return iv.interval_join(clips, windows, ["user_id"], BIN_MS, iv.left_inside_right()).select("window_id", "event_id")


@query("point_in_interval", _CLIPS + """
SELECT window_id, event_id FROM w JOIN e ON w.user_id = e.user_id WHERE start_ms BETWEEN w_start AND w_end""")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants inside a window, its ends included."""
    points = _clips(spark, sf_dir).select("event_id", "user_id", "start_ms", F.col("start_ms").alias("end_ms"))
    windows = purchase_windows(spark, sf_dir).select("window_id", "user_id", "start_ms", "end_ms")
    return iv.interval_join(points, windows, ["user_id"], BIN_MS, iv.left_inside_right()).select("window_id", "event_id")


@query("pool_current", _CLIPS + """
SELECT window_id, event_id FROM w JOIN e ON w.user_id = e.user_id AND w.day = e.day
WHERE event_type <> 'purchase' AND start_ms <= w_end AND end_ms >= w_start""")
def pool_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a window's user and day that touch it within its margin."""
    chunks = _clips(spark, sf_dir).filter("event_type <> 'purchase'").select("event_id", "user_id", "day", "start_ms", "end_ms")
    windows = purchase_windows(spark, sf_dir).select("window_id", "user_id", "day", "start_ms", "end_ms")
    return iv.interval_join(windows, chunks, ["user_id", "day"], BIN_MS, iv.touching()).select("window_id", "event_id")


@query("pool_history", _CLIPS + """
SELECT window_id, count(event_id) AS n_history FROM w LEFT JOIN e ON w.user_id = e.user_id AND event_type <> 'purchase' AND end_ms <= core_ms GROUP BY window_id""")
def pool_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of its user ended before a window begins, by a running count."""
    chunks = _clips(spark, sf_dir).filter("event_type <> 'purchase'")
    return iv.history_counts(chunks, purchase_windows(spark, sf_dir), ["user_id"], "end_ms", "core_ms", "window_id")


@query("union_distinct_pools", _CLIPS + """
, c AS (SELECT window_id, event_id FROM w JOIN e ON w.user_id = e.user_id AND w.day = e.day WHERE event_type <> 'purchase' AND start_ms <= w_end AND end_ms >= w_start),
h AS (SELECT window_id, event_id FROM w JOIN e ON w.user_id = e.user_id AND w.day = e.day WHERE event_type <> 'purchase' AND end_ms <= core_ms),
u AS (SELECT window_id, event_id, 0 AS rank FROM c UNION ALL SELECT window_id, event_id, 1 FROM h)
SELECT window_id, event_id, CASE min(rank) WHEN 0 THEN 'current' ELSE 'history' END AS pool FROM u GROUP BY window_id, event_id""")
def union_distinct_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current and same-day history pools as one; a chunk of both counts as current."""
    chunks = _clips(spark, sf_dir).filter("event_type <> 'purchase'").select("event_id", "user_id", "day", "end_ms")
    windows = purchase_windows(spark, sf_dir).select("window_id", "user_id", "day", "core_ms")
    # history of one day only: a user's day bounds the pairs
    history = windows.join(chunks, ["user_id", "day"]).filter("end_ms <= core_ms").select("window_id", "event_id", F.lit(1).alias("rank"))
    both = pool_current(spark, sf_dir).withColumn("rank", F.lit(0)).unionByName(history)
    first = both.groupBy("window_id", "event_id").agg(F.min("rank").alias("rank"))
    return first.select("window_id", "event_id", F.when(F.col("rank") == 0, "current").otherwise("history").alias("pool"))


@query("band_self_join", _CLIPS + """
SELECT a.day, a.event_id AS a_id, b.event_id AS b_id, abs(a.start_ms - b.start_ms) AS gap_ms
FROM e a JOIN e b ON a.day = b.day AND a.user_id < b.user_id AND abs(a.start_ms - b.start_ms) <= 90000""")
def band_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different users' clips of a day that start at most 90 seconds apart.

    One side is put into the bins its band touches, so the join has an equality on (day, bin). It is cut into parts by the number of
    clips, not of their bytes: pairs may grow with the square of the clips, and a part of few clips repeats few ids, which
    Parquet keeps as a dictionary and short codes as long as they fit a page. Both sides are in order of time, and bins are short, so
    clips that follow each other meet the same ids in the same order, and these codes compress.
    """
    clips = _clips(spark, sf_dir)
    first, last = F.floor((F.col("start_ms") - 90_000) / PAIR_BIN_MS), F.floor((F.col("start_ms") + 90_000) / PAIR_BIN_MS)
    a = clips.select("day", F.col("event_id").alias("a_id"), F.col("user_id").alias("ua"), F.col("start_ms").alias("sa"), F.explode(F.sequence(first, last)).alias("bin"))
    b = clips.select("day", F.col("event_id").alias("b_id"), F.col("user_id").alias("ub"), F.col("start_ms").alias("sb"), F.floor(F.col("start_ms") / PAIR_BIN_MS).alias("bin"))
    n_parts = max(spark.sparkContext.defaultParallelism, clips.count() // PART_CLIPS)
    # Spark drops a sort right below a join; it stays below a filter that isn't deterministic, and the merge join takes its order over
    every = F.monotonically_increasing_id() >= 0
    a = a.repartition(n_parts, "day", "bin").sortWithinPartitions("day", "bin", "sa", "ua", "a_id").filter(every)
    b = b.repartition(n_parts, "day", "bin").sortWithinPartitions("day", "bin", "sb", "ub", "b_id").filter(every)
    gap = F.abs(F.col("sa") - F.col("sb"))
    return a.join(b.hint("merge"), ["day", "bin"]).filter((F.col("ua") < F.col("ub")) & (gap <= 90_000)).select("day", "a_id", "b_id", gap.alias("gap_ms"))


@query("fixed_windows", _CLIPS + """
SELECT day, sod_ms // 600000 AS slot, count(*) AS n_events, count(DISTINCT user_id) AS n_users,
  string_agg(event_id::VARCHAR, ',' ORDER BY start_ms, event_id) AS event_ids
FROM e WHERE sod_ms >= 32400000 AND sod_ms < 82800000 GROUP BY day, slot""")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute windows from 09:00 to 23:00 with what happens in them, in order; empty ones are absent."""
    inside = _clips(spark, sf_dir).filter((F.col("sod_ms") >= 32_400_000) & (F.col("sod_ms") < 82_800_000))
    slot = F.floor(F.col("sod_ms") / 600_000).alias("slot")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "event_id"))), lambda s: s["event_id"].cast("string"))
    return inside.groupBy("day", slot).agg(
        F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.array_join(ids, ",").alias("event_ids")
    )


@query("bin_grid_active", _CLIPS + """
, s AS (SELECT *, start_ms + 900000 AS long_end FROM e),
b AS (SELECT day, event_type, user_id, unnest(range(CAST(ceil(start_ms / 300000.0) AS BIGINT), CAST(floor(long_end / 300000.0) AS BIGINT))) AS bin FROM s)
SELECT bin // 288 AS day, bin % 288 AS slot, count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id END) AS n_moving,
  count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS n_static,
  CASE WHEN (bin % 288) // 12 BETWEEN 6 AND 11 THEN 'morning' WHEN (bin % 288) // 12 BETWEEN 12 AND 16 THEN 'afternoon'
    WHEN (bin % 288) // 12 BETWEEN 17 AND 23 THEN 'evening' ELSE 'night' END AS period
FROM b GROUP BY bin HAVING count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id END) >= 2""")
def bin_grid_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bins that at least two moving streams of fifteen minutes cover from end to end."""
    streams = _clips(spark, sf_dir).withColumn("long_end", F.col("start_ms") + 900_000)
    bins = iv.full_bins(streams, ["user_id"], "start_ms", "long_end", 300_000)
    moving = F.countDistinct(F.when(F.col("event_type") != "error", F.col("user_id")))
    static = F.countDistinct(F.when(F.col("event_type") == "error", F.col("user_id")))
    counted = bins.groupBy("bin").agg(moving.alias("n_moving"), static.alias("n_static")).filter("n_moving >= 2")
    slot = F.col("bin") % 288
    return counted.select(F.floor(F.col("bin") / 288).alias("day"), slot.alias("slot"), "n_moving", "n_static", tm.day_period(slot * 300_000).alias("period"))


@query("dense_grid", _CLIPS + """
SELECT window_id, unnest(range(w_start + 30000, w_end, 60000)) AS at_ms FROM w""")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instant a minute in every window, from half a step in."""
    windows = purchase_windows(spark, sf_dir).select("window_id", "start_ms", "end_ms")
    return iv.dense_grid(windows, "start_ms", "end_ms", 60_000).select("window_id", "at_ms")


@query("uniform_allocation", _CLIPS + """
, r AS (SELECT user_id, event_id, start_ms, end_ms - start_ms AS len,
    sum(end_ms - start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id) - (end_ms - start_ms) AS before,
    sum(end_ms - start_ms) OVER (PARTITION BY user_id) AS total FROM e),
i AS (SELECT unnest(range(8)) AS i)
SELECT user_id, i::INTEGER AS i, event_id, (start_ms + ((2 * i + 1) * total) // 16 - before)::BIGINT AS at_ms
FROM r JOIN i ON ((2 * i + 1) * total) // 16 >= before AND ((2 * i + 1) * total) // 16 < before + len""")
def uniform_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight instants spread evenly over all clips of a user laid end to end."""
    return iv.uniform_allocation(_clips(spark, sf_dir), ["user_id"], "start_ms", "end_ms", ["event_id"], 8).select("user_id", "i", "event_id", "at_ms")


@query("window_targets", _CLIPS + """
SELECT event_id, target, (CASE WHEN event_type = 'click' THEN start_ms + [5000, 15000, 25000][target + 1]
  WHEN event_type = 'view' THEN (start_ms + end_ms) // 2 + [-10000, 0, 10000][target + 1]
  ELSE start_ms + (end_ms - start_ms) * [25, 50, 75][target + 1] // 100 END)::BIGINT AS at_ms
FROM e, (SELECT unnest(range(3))::INTEGER AS target)""")
def window_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three target instants of a clip, by its type: fixed offsets, around the centre, or quarters."""
    start, end = F.col("start_ms"), F.col("end_ms")
    offsets = (
        F.when(F.col("event_type") == "click", F.array(*[start + x for x in (5000, 15000, 25000)]))
        .when(F.col("event_type") == "view", F.array(*[F.floor((start + end) / 2) + x for x in (-10000, 0, 10000)]))
        .otherwise(F.array(*[start + F.floor((end - start) * x / 100) for x in (25, 50, 75)]))
    )
    return _clips(spark, sf_dir).select("event_id", F.posexplode(offsets).alias("target", "at_ms"))


@query("clamp_offsets", _CLIPS + """
SELECT window_id, event_id, least(greatest(core_ms - start_ms, 0), 29500) AS offset_ms
FROM w JOIN e ON w.user_id = e.user_id WHERE start_ms < w_end AND end_ms > w_start""")
def clamp_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a window's centre lies in each overlapping clip, kept half a second inside it."""
    windows = purchase_windows(spark, sf_dir).select("window_id", "user_id", "core_ms", "start_ms", "end_ms")
    clips = _clips(spark, sf_dir).select("event_id", "user_id", "start_ms", "end_ms")
    pairs = iv.interval_join(windows, clips, ["user_id"], BIN_MS, iv.strict_overlap())
    offset = F.least(F.greatest(F.col("core_ms") - F.col("r_start_ms"), F.lit(0)), F.lit(29_500))
    return pairs.select("window_id", "event_id", offset.alias("offset_ms"))


@query("prefer_then_fallback", _CLIPS + """
, o AS (SELECT w.day, w.window_id, e.event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS grain, abs(start_ms - core_ms) AS gap
  FROM w JOIN e ON w.user_id = e.user_id AND w.day = e.day WHERE event_id <> window_id),
r AS (SELECT *, row_number() OVER (PARTITION BY day, window_id ORDER BY grain, gap, event_id) AS n FROM o)
SELECT day, window_id, event_id, grain::INTEGER AS grain, n::INTEGER AS n FROM r WHERE n <= 2""")
def prefer_then_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clips of a window's user and day: of the fine grain first, of the coarse if there are too few."""
    windows = purchase_windows(spark, sf_dir).select("window_id", "user_id", "day", "core_ms")
    clips = _clips(spark, sf_dir).select("event_id", "user_id", "day", "start_ms", F.when(F.col("event_type") == "view", 0).otherwise(1).alias("grain"))
    pairs = windows.join(clips, ["user_id", "day"]).filter("event_id <> window_id").withColumn("gap", F.abs(F.col("start_ms") - F.col("core_ms")))
    n = F.row_number().over(Window.partitionBy("day", "window_id").orderBy("grain", "gap", "event_id"))
    return pairs.withColumn("n", n).filter("n <= 2").select("day", "window_id", "event_id", "grain", "n")


@query("interval_parse_wrap", _CLIPS + """
, p AS (SELECT event_id, (sod_ms // 1000) * 1000 AS start_at, ((sod_ms // 1000) * 1000 + 3600000) % 86400000 AS end_at FROM e WHERE event_type <> 'error')
SELECT event_id, start_at, CASE WHEN end_at < start_at THEN end_at + 86400000 ELSE end_at END AS end_at FROM p""")
def interval_parse_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock strings of an hour's span parsed back; an end before its start lies on the next day."""
    rows = _clips(spark, sf_dir).filter("event_type <> 'error'")
    text = lambda ms: F.substring(tm.millis_clock(ms), 1, 8)
    shown = rows.select("event_id", text(F.col("sod_ms")).alias("start_time"), text(F.col("sod_ms") + 3_600_000).alias("end_time"))
    start, end = tm.clock_millis("start_time"), tm.clock_millis("end_time")
    return shown.select("event_id", start.alias("start_at"), tm.wrap_midnight(start, end).alias("end_at"))


@query("clip_index", _CLIPS + """
SELECT 'U' || user_id || '_DAY' || (day - 19722) || '_' || event_id || '.mp4' AS name, user_id::BIGINT AS agent, day - 19722 AS day, sod_ms AS start_at, sod_ms + 30000 AS end_at FROM e""")
def clip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of clips parsed to (agent, day), with the span the clip lasts."""
    named = _clips(spark, sf_dir).select(
        "sod_ms", F.concat(F.lit("U"), "user_id", F.lit("_DAY"), F.col("day") - 19722, F.lit("_"), "event_id", F.lit(".mp4")).alias("name")
    )
    part = lambda i: F.regexp_extract("name", r"^U(\d+)_DAY(\d+)_(\d+)\.mp4$", i).try_cast("long")
    return named.select("name", part(1).alias("agent"), part(2).alias("day"), F.col("sod_ms").alias("start_at"), (F.col("sod_ms") + 30_000).alias("end_at"))


@query("take_until_failures", """
WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY n) AS run FROM o),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type = 'error', run ORDER BY n) AS k FROM r),
s AS (SELECT user_id, min(n) AS stop FROM c WHERE event_type = 'error' AND k >= 2 GROUP BY user_id)
SELECT o.user_id, event_id, CASE WHEN stop IS NULL OR n <= stop THEN event_type ELSE 'not_attempted' END AS status FROM o LEFT JOIN s USING (user_id)""")
def take_until_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A circuit breaker: after two failures in a row nothing more of a user is attempted."""
    keys, order = ["user_id"], ["ts", "event_id"]
    failed = (F.col("event_type") == "error").cast("int")
    events = stretched(load(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", failed.alias("fail")), keys, order)
    with_last = running(events, keys, order, {"last": Running(F.col("fail"), "last", current=False)})
    trip = ((F.col("fail") == 1) & F.coalesce(F.col("last") == 1, F.lit(False))).cast("int")
    judged = running(with_last.withColumn("trip", trip), keys, order, {"over": Running(F.col("trip"), "max", current=False)})
    return judged.select("user_id", "event_id", F.when(F.col("over") == 1, "not_attempted").otherwise(F.col("event_type")).alias("status"))
