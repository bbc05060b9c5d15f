"""Evaluation queries: labels are trials, quality says whether one is correct, toxic whether it has
no answer; a document's source is the condition and its language the mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators.sketches import estimates, merge_states, sketch_states
from ..sources.tables import load
from .registry import query

_TRIALS = """
WITH t AS (SELECT doc_id, source, lang, quality = 1 AS correct, toxic = 0 AS answered, n_chars FROM labels JOIN documents USING (doc_id))
"""


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    marks = load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 0).alias("answered"))
    return docs.join(marks, "doc_id")


_BLOCK = "count(*) AS trials, count_if(answered)::BIGINT AS answered, count_if(correct)::BIGINT AS correct, round(count_if(correct) / count(*), 6) AS accuracy"


@query("accuracy_by_group", _TRIALS + f"SELECT source, {_BLOCK} FROM t GROUP BY source")
def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.accuracy_block(_trials(spark, sf_dir), ["source"], "correct", "answered")


@query("grouping_sets_summary", _TRIALS + f"""
SELECT CASE WHEN grouping(source) = 1 AND grouping(lang) = 1 THEN 'overall' WHEN grouping(lang) = 1 THEN 'source'
  WHEN grouping(source) = 1 THEN 'lang' ELSE 'source+lang' END AS grain, source, lang, {_BLOCK}
FROM t GROUP BY GROUPING SETS ((), (source), (lang), (source, lang))""")
def grouping_sets_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [[], ["source"], ["lang"], ["source", "lang"]]
    return ev.grouping_summary(_trials(spark, sf_dir), sets, ["source", "lang"], "correct", "answered")


@query("dense_cube_zero_fill", _TRIALS + """
SELECT s.source, l.lang, count(t.doc_id) AS trials, coalesce(count_if(t.correct), 0)::BIGINT AS correct,
  CASE WHEN count(t.doc_id) = 0 THEN 0.0 ELSE round(count_if(t.correct) / count(t.doc_id), 6) END AS accuracy
FROM (SELECT DISTINCT source FROM t) s CROSS JOIN (SELECT DISTINCT lang FROM t) l
LEFT JOIN t ON t.source = s.source AND t.lang = l.lang GROUP BY s.source, l.lang""")
def dense_cube_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.dense_cube(_trials(spark, sf_dir), "source", "lang", "correct")


@query("oracle_best_any", _TRIALS + """
, q AS (SELECT doc_id % 100 AS question, lang, bool_or(correct) AS correct, bool_or(answered) AS answered FROM t GROUP BY ALL)
SELECT lang, count(*) AS questions, count_if(answered)::BIGINT AS answered, count_if(correct)::BIGINT AS correct, round(avg(correct::INTEGER), 6) AS accuracy
FROM q GROUP BY lang""")
def oracle_best_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred questions, each with several trials per language."""
    trials = _trials(spark, sf_dir).withColumn("question", F.col("doc_id") % 100)
    return ev.best_of(trials, "question", ["lang"], "correct", "answered")


@query("unordered_pair_group", _TRIALS + """
, p AS (SELECT a.correct AND b.correct AS correct, a.answered OR b.answered AS answered, least(a.source, b.source) || '_' || greatest(a.source, b.source) AS pair
  FROM t a JOIN t b ON a.doc_id // 8 = b.doc_id // 8 AND a.doc_id <> b.doc_id AND a.source <> b.source)
SELECT pair, """ + _BLOCK + " FROM p GROUP BY pair")
def unordered_pair_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of trials of a block of eight documents, under one name for either order."""
    trials = _trials(spark, sf_dir).withColumn("block", F.floor(F.col("doc_id") / 8))
    a = trials.select("block", *[F.col(c).alias(f"{c}_a") for c in ("doc_id", "source", "correct", "answered")])
    b = trials.select("block", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "source", "correct", "answered")])
    pairs = a.join(b, "block").filter("doc_id_a <> doc_id_b and source_a <> source_b")
    named = pairs.select(
        ev.group_label(F.array("source_a", "source_b")).alias("pair"),
        (F.col("correct_a") & F.col("correct_b")).alias("correct"), (F.col("answered_a") | F.col("answered_b")).alias("answered"),
    )
    return ev.accuracy_block(named, ["pair"], "correct", "answered")


@query("group_mean_argmax", _TRIALS + """
, c AS (SELECT source, substr(source, 4)::INTEGER % 3 AS size, avg(correct::INTEGER) AS accuracy FROM t GROUP BY source)
SELECT size, count(*) AS conditions, round(avg(accuracy), 6) AS mean_accuracy, arg_max(source, (round(accuracy, 9), source)) AS best FROM c GROUP BY size""")
def group_mean_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy of the conditions of a size, and the best of them."""
    by_source = _trials(spark, sf_dir).groupBy("source").agg(F.avg(F.col("correct").cast("int")).alias("accuracy"))
    sized = by_source.withColumn("size", F.substring("source", 4, 9).cast("int") % 3)
    return sized.groupBy("size").agg(
        F.count("*").alias("conditions"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy"),
        F.max_by("source", F.struct(F.round("accuracy", 9), "source")).alias("best"),
    )


@query("value_counts_percent", """
SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM events GROUP BY event_type""")
def value_counts_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("multilabel_counts", """
WITH f AS (SELECT n_chars > 1500 AS long, text LIKE '%|%' AS piped, text LIKE '%License%' AS licensed, lang = 'en' AS english FROM documents)
SELECT label, count_if(v)::BIGINT AS n FROM (SELECT unnest(['long', 'piped', 'licensed', 'english']) AS label, unnest([long, piped, licensed, english]) AS v FROM f) GROUP BY label""")
def multilabel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents carry each of several labels."""
    flags = load(spark, sf_dir, "documents").select(
        (F.col("n_chars") > 1500).cast("int").alias("long"), F.col("text").contains("|").cast("int").alias("piped"),
        F.col("text").contains("License").cast("int").alias("licensed"), (F.col("lang") == "en").cast("int").alias("english"),
    )
    totals = flags.agg(*[F.sum(c).alias(c) for c in flags.columns])
    return totals.unpivot([], totals.columns, "label", "n")


@query("conditional_agg_set", """
SELECT user_id, count(*) AS total, count_if(event_type <> 'error')::BIGINT AS usable, round(sum(value), 2) AS amount,
  array_to_string(list_sort(list(DISTINCT event_type)), ';') AS kinds FROM events GROUP BY user_id""")
def conditional_agg_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("usable"), F.round(F.sum("value"), 2).alias("amount"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("kinds"),
    )


@query("ordered_distinct", """
WITH f AS (SELECT user_id, event_type, min(ts) AS first FROM events GROUP BY user_id, event_type)
SELECT user_id, string_agg(event_type, '>' ORDER BY first, event_type) AS order_seen FROM f GROUP BY user_id""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different event types of a user in the order they were first seen."""
    first = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first"))
    in_order = F.sort_array(F.collect_list(F.struct("first", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(in_order, lambda s: s["event_type"]), ">").alias("order_seen"))


@query("answer_difference", """
WITH e AS (SELECT event_id, user_id, ts::DATE AS day, event_type, round(value)::BIGINT % 5 AS choice, ts FROM events),
m AS (SELECT user_id, day, arg_max(choice, (ts, event_id)) AS multi FROM e WHERE event_type = 'view' GROUP BY user_id, day),
s AS (SELECT user_id, day, event_id, choice FROM e WHERE event_type = 'click'),
j AS (SELECT s.*, m.multi, choice <> multi AS changed FROM s JOIN m USING (user_id, day))
SELECT user_id, epoch(day)::BIGINT // 86400 AS day, any_value(multi) AS multi, count(*) AS singles, count_if(changed)::BIGINT AS changed,
  round(count_if(changed) / count(*), 6) AS rate, coalesce(string_agg(event_id::VARCHAR, ';' ORDER BY event_id) FILTER (WHERE changed), '') AS changed_ids
FROM j GROUP BY user_id, day""")
def answer_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are single answers, the last view of a user's day the joint one: where they differ."""
    e = load(spark, sf_dir, "events").withColumn("day", F.unix_date(F.col("ts").cast("date")).cast("long")).withColumn("choice", F.round("value").cast("long") % 5)
    joint = e.filter("event_type = 'view'").groupBy("user_id", "day").agg(F.max_by("choice", F.struct("ts", "event_id")).alias("multi"))
    single = e.filter("event_type = 'click'").select("user_id", "day", "event_id", "choice")
    both = single.join(joint, ["user_id", "day"]).withColumn("differs", F.col("choice") != F.col("multi"))
    n = F.count_if("differs")
    ids = F.array_sort(F.collect_list(F.when(F.col("differs"), F.col("event_id"))))
    return both.groupBy("user_id", "day").agg(
        F.first("multi").alias("multi"), F.count("*").alias("singles"), n.alias("changed"), F.round(n / F.count("*"), 6).alias("rate"),
        F.array_join(F.transform(ids, lambda i: i.cast("string")), ";").alias("changed_ids"),
    )


@query("median_stats", """
SELECT event_type, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS median,
  arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY event_type""")
def median_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, order = load(spark, sf_dir, "events"), F.struct("ts", "event_id")
    ends = events.groupBy("event_type").agg(
        F.min("value").alias("least"), F.max("value").alias("most"),
        F.min_by("event_id", order).alias("first_id"), F.max_by("event_id", order).alias("last_id"),
    )
    return ends.join(ev.exact_median(events, "event_type", "value").withColumn("median", F.round("median", 6)), "event_type")


@query("avg_ignore_blank", """
WITH r AS (SELECT source, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'n/a' ELSE n_chars::VARCHAR END AS field FROM documents)
SELECT source, round(avg(try_cast(nullif(field, '') AS DOUBLE)), 6) AS mean, count(try_cast(nullif(field, '') AS DOUBLE)) AS n FROM r GROUP BY source""")
def avg_ignore_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a text field whose blank and non-numeric values don't count."""
    field = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 11 == 0, "n/a").otherwise(F.col("n_chars").cast("string"))
    number = F.nullif("field", F.lit("")).try_cast("double")
    rows = load(spark, sf_dir, "documents").select("source", field.alias("field"))
    return rows.groupBy("source").agg(F.round(F.avg(number), 6).alias("mean"), F.count(number).alias("n"))


@query("recall_metrics", """
WITH f AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0) AS found, list(DISTINCT event_type) FILTER (WHERE value > 400) AS wanted,
  count_if(event_type = 'error')::BIGINT AS off, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN wanted IS NULL THEN NULL ELSE round(len(list_intersect(coalesce(found, []), wanted)) / len(wanted), 6) END AS recall, round(off / n, 6) AS off_rate FROM f""")
def recall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the labels seen in even events among those of high value; share of events that are off."""
    sets = load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("found"),
        F.collect_set(F.when(F.col("value") > 400, F.col("event_type"))).alias("wanted"),
        F.count_if(F.col("event_type") == "error").alias("off"), F.count("*").alias("n"),
    )
    return sets.select("user_id", F.round(ev.set_recall(F.col("found"), F.col("wanted")), 6).alias("recall"), F.round(F.col("off") / F.col("n"), 6).alias("off_rate"))


@query("having_multi_entity", """
SELECT epoch_us(ts) // 600000000 AS slot, count(DISTINCT user_id) AS users, array_to_string(list_sort(list(DISTINCT user_id)), ';') AS members
FROM events GROUP BY slot HAVING count(DISTINCT user_id) >= 2""")
def having_multi_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute slots that two or more users share."""
    slot = F.floor((F.unix_date(F.col("ts").cast("date")).cast("long") * 1440 + F.hour("ts") * 60 + F.minute("ts")) / 10)
    users = F.array_sort(F.collect_set("user_id"))
    grouped = load(spark, sf_dir, "events").groupBy(slot.alias("slot")).agg(users.alias("set"))
    return grouped.filter(F.size("set") >= 2).select(
        "slot", F.size("set").cast("long").alias("users"), F.array_join(F.transform("set", lambda u: u.cast("string")), ";").alias("members")
    )


@query("pivot_counts", """
SELECT user_id, count_if(event_type = 'click')::BIGINT AS click, count_if(event_type = 'view')::BIGINT AS "view", count_if(event_type = 'purchase')::BIGINT AS purchase FROM events GROUP BY user_id""")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = load(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).count()
    return pivoted.na.fill(0, ["click", "view", "purchase"])


@query("status_rollup", """
WITH c AS (SELECT o_custkey, count_if(o_orderstatus = 'F')::BIGINT AS done, count(*) AS total FROM orders GROUP BY o_custkey)
SELECT o_custkey, done, total, CASE WHEN done = 0 THEN 'none' WHEN done = total THEN 'all' ELSE 'partial' END AS status FROM c""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("total"))
    return counts.withColumn("status", ev.status_of(F.col("done"), F.col("total")))


@query("running_accuracy", _TRIALS + """
SELECT source, doc_id, round(avg(correct::INTEGER) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 6) AS so_far FROM t""")
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far = ev.running_mean(_trials(spark, sf_dir), "source", "doc_id", F.col("correct").cast("int"))
    return so_far.select("source", "doc_id", F.round("mean", 6).alias("so_far"))


@query("gate_bool_agg", """
WITH p AS (SELECT conv_id, role = 'assistant' AS combined, len(text) > 200 AS correct, role FROM conversations)
SELECT conv_id, coalesce(bool_or(combined AND correct), false) AND NOT coalesce(bool_or(NOT combined AND correct), false) AS answerable, bool_and(correct) AS all_pass,
  count_if(NOT correct)::BIGINT AS failures FROM p GROUP BY conv_id""")
def gate_bool_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item passes if a combined answer is correct and no single one is; all checks must pass."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", (F.col("role") == "assistant").alias("combined"), (F.length("text") > 200).alias("correct"))
    together, alone = F.bool_or(F.col("combined") & F.col("correct")), F.bool_or(~F.col("combined") & F.col("correct"))
    return turns.groupBy("conv_id").agg(
        (F.coalesce(together, F.lit(False)) & ~F.coalesce(alone, F.lit(False))).alias("answerable"),
        F.bool_and("correct").alias("all_pass"), F.count_if(~F.col("correct")).alias("failures"),
    )


@query("combination_groups", """
WITH m AS (SELECT conv_id, list_sort(list(DISTINCT role)) AS who FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, unnest(who) AS r FROM m)
SELECT conv_id, 'single' AS kind, r AS members FROM u
UNION ALL SELECT a.conv_id, 'pair', a.r || '+' || b.r FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.r < b.r
UNION ALL SELECT conv_id, 'all', array_to_string(who, '+') FROM m""")
def combination_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's speakers one by one, in pairs and all together."""
    members = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("who"))
    kind = lambda name, sets: F.transform(sets, lambda x: F.struct(F.lit(name).alias("kind"), x.alias("members")))
    who = F.col("who")
    pairs = F.flatten(F.transform(who, lambda a: F.transform(F.filter(who, lambda b: b > a), lambda b: F.concat(a, F.lit("+"), b))))
    groups = F.concat(kind("single", who), kind("pair", pairs), kind("all", F.array(F.array_join(who, "+"))))
    return members.select("conv_id", F.explode(groups).alias("g")).select("conv_id", "g.kind", "g.members")


@query("sketch_rollup", """
SELECT event_type, user_id % 10 AS part, count(*) AS n, count(DISTINCT event_id % 3000) AS exact, true AS near_distinct, true AS near_median FROM events
GROUP BY GROUPING SETS ((event_type, user_id % 10), (event_type), ())""")
def sketch_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts and medians from sketches merged over grouping sets, held against exact ones: 6 % of the count, 5 % of the rank."""
    rows = load(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("part"), (F.col("event_id") % 3000).alias("item"), "value")
    sets = [["event_type", "part"], ["event_type"], []]
    merged = estimates(merge_states(sketch_states(rows, ["event_type", "part"], "item", "value"), sets), 0.5)
    # exact counts of the same sets, from rows that know the estimated median of each
    spread = rows.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i")) for i in range(3)]))).select(
        F.when(F.col("s.i") < 2, F.col("event_type")).alias("e"), F.when(F.col("s.i") < 1, F.col("part")).alias("p"), "item", "value"
    )
    same = F.col("event_type").eqNullSafe(F.col("e")) & F.col("part").eqNullSafe(F.col("p"))
    held = spread.join(F.broadcast(merged.select("event_type", "part", "at_quantile")), same)  # a row for each group of the sets
    exact = held.groupBy("e", "p").agg(F.countDistinct("item").alias("exact"), F.avg((F.col("value") <= F.col("at_quantile")).cast("double")).alias("rank"))
    return merged.join(exact, same).select(
        "event_type", "part", "n", "exact", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.06 * F.col("exact") + 1).alias("near_distinct"),
        F.col("rank").between(0.45 - 1 / F.col("n"), 0.55 + 1 / F.col("n")).alias("near_median"),
    )
