"""Smaller operators (conditions, options, schedules, checks) and generic window and set forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ordered import Running, running, stretched
from ..sources.tables import events_as_intervals, load
from .registry import query


def parse_condition(text: Column, aliases: dict[str, str]) -> tuple[Column, Column]:
    """(members, valid): names cut at ``_``, ``+`` or ``,``, title-cased, aliases resolved; a condition
    that names someone twice or no one is not valid."""
    names = F.filter(F.split(text, "[_+,]"), lambda n: F.btrim(n) != "")
    lookup = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    members = F.transform(names, lambda n: F.coalesce(F.try_element_at(lookup, F.initcap(F.btrim(n))), F.initcap(F.btrim(n))))
    return members, (F.size(members) > 0) & (F.size(F.array_distinct(members)) == F.size(members))


_NAMES_SQL = "CASE event_id % 4 WHEN 0 THEN event_type || '+bo' WHEN 1 THEN 'bob_' || event_type || ', ' || 'BO' WHEN 2 THEN ' ' || event_type || ',cleo_' ELSE '' END"


@query("condition_parse", f"""
WITH c AS (SELECT event_id, {_NAMES_SQL} AS text FROM events),
n AS (SELECT event_id, list_transform(list_filter(string_split_regex(text, '[_+,]'), lambda x: trim(x) <> ''), lambda x: upper(trim(x)[1]) || lower(trim(x)[2:])) AS names FROM c),
m AS (SELECT event_id, list_transform(names, lambda x: CASE x WHEN 'Bo' THEN 'Bob' ELSE x END) AS members FROM n)
SELECT event_id, array_to_string(members, '_') AS members, len(members) > 0 AND len(list_distinct(members)) = len(members) AS valid FROM m""")
def condition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a condition's name; an alias stands for its owner."""
    kind, k = F.col("event_type"), F.col("event_id") % 4
    text = (
        F.when(k == 0, F.concat(kind, F.lit("+bo"))).when(k == 1, F.concat(F.lit("bob_"), kind, F.lit(", "), F.lit("BO")))
        .when(k == 2, F.concat(F.lit(" "), kind, F.lit(",cleo_"))).otherwise("")
    )
    members, valid = parse_condition(F.col("text"), {"Bo": "Bob"})
    rows = load(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return rows.select("event_id", F.array_join(members, "_").alias("members"), valid.alias("valid"))


@query("option_expansion", r"""
WITH r AS (SELECT event_id, 'Which? A) ' || event_type || ', B) ' || user_id || ' C)value ' || event_id || '.' || CASE WHEN event_id % 7 = 0 THEN '  B) again;' ELSE '' END AS q,
  CASE event_id % 7 WHEN 0 THEN 'A-B' WHEN 1 THEN 'B' WHEN 2 THEN 'A-C' WHEN 3 THEN ' C-A ' WHEN 4 THEN 'E' WHEN 5 THEN 'A - B  or  ' || event_type ELSE 'D-B' END AS a FROM events),
s AS (SELECT event_id, trim(regexp_replace(a, '\s+', ' ', 'g')) AS a, regexp_extract_all(q, '\b([A-E])\)\s*', 1) AS ls, string_split_regex(q, '\b[A-E]\)\s*')[2:] AS ts FROM r),
e AS (SELECT event_id, a, array_to_string(list_transform(string_split(a, '-'), lambda x:
    coalesce(trim(regexp_replace(trim(list_filter(list_zip(ls, ts), lambda p: p[1] = x)[-1][2], ' ,.;'), '\s+', ' ', 'g')), '')), ' ') AS listed FROM s)
SELECT event_id, CASE WHEN regexp_full_match(a, '[A-E](-[A-E])*') AND listed <> '' THEN listed ELSE a END AS options FROM e""")
def option_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the options that an answer lists; other answers stay."""
    i = F.col("event_id")
    again = F.when(i % 7 == 0, "  B) again;").otherwise("")
    question = F.concat(F.lit("Which? A) "), "event_type", F.lit(", B) "), F.col("user_id").cast("string"), F.lit(" C)value "), i.cast("string"), F.lit("."), again)
    answers = ["A-B", "B", "A-C", " C-A ", "E", F.concat(F.lit("A - B  or  "), "event_type")]
    answer = F.lit("D-B")
    for k, a in enumerate(answers):
        answer = F.when(i % 7 == k, a).otherwise(answer)
    rows = load(spark, sf_dir, "events").select("event_id", question.alias("q"), answer.alias("a"))
    return rows.select("event_id", tx.expand_options("q", "a").alias("options"))


@query("status_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority <> '5-LOW'")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = load(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderpriority") != "5-LOW"))
    return kept.select("o_orderkey", "o_orderstatus")


@query("referential_check", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l.l_orderkey AND o_orderstatus <> 'P')""")
def referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that refer to no order that is open to reference."""
    known = load(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(known, "l_orderkey", "left_anti")


@query("retrieval_query_build", "SELECT item_id, text || ' ' || 'answer ' || item_id AS query, text AS without_answer FROM benchmark")
def retrieval_query_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query of a question, with its gold answer (which leaks it, by design) and without."""
    answer = F.concat(F.lit("answer "), F.col("item_id").cast("string"))
    return load(spark, sf_dir, "benchmark").select("item_id", F.concat_ws(" ", "text", answer).alias("query"), F.col("text").alias("without_answer"))


@query("alternating_quota", """
WITH r AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'common' ELSE 'different' END AS kind, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts, event_id) AS k FROM r)
SELECT user_id, (2 * k - CASE WHEN kind = 'common' THEN 1 ELSE 0 END)::INTEGER AS place, event_id, kind FROM n WHERE k <= 5""")
def alternating_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each of two kinds per user, taking turns."""
    kind = F.when(F.col("event_type").isin("click", "view"), "common").otherwise("different")
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", kind.alias("kind"))
    k = F.row_number().over(Window.partitionBy("user_id", "kind").orderBy("ts", "event_id"))
    place = 2 * F.col("k") - F.when(F.col("kind") == "common", 1).otherwise(0)
    return rows.withColumn("k", k).filter("k <= 5").select("user_id", place.cast("int").alias("place"), "event_id", "kind")


@query("prompt_build", """
SELECT item_id, 'Question: ' || text || chr(10) || 'Category: ' || item_id % 3 || chr(10) || 'Answer with one letter.' AS prompt FROM benchmark""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.concat_ws("\n", F.concat(F.lit("Question: "), "text"), F.concat(F.lit("Category: "), (F.col("item_id") % 3).cast("string")), F.lit("Answer with one letter."))
    return load(spark, sf_dir, "benchmark").select("item_id", lines.alias("prompt"))


@query("intersect_except", """
SELECT 'both' AS part, k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'only_f', k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def intersect_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: load(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    both, only = of("F").intersect(of("O")), of("F").subtract(of("O"))
    return both.select(F.lit("both").alias("part"), "k").unionByName(only.select(F.lit("only_f").alias("part"), "k"))


_CLIPS_SQL = "WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events)"


@query("session_windows", _CLIPS_SQL + """
, g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) < 21600000 THEN 0 ELSE 1 END AS fresh FROM e),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS session FROM g)
SELECT user_id, min(ms) AS start_ms, max(ms) AS last_ms, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, ended by a gap of six hours."""
    e = events_as_intervals(spark, sf_dir).select("user_id", F.col("start_ms").alias("ms"), F.timestamp_millis("start_ms").alias("at"))
    grouped = e.groupBy("user_id", F.session_window("at", "6 hours"))
    return grouped.agg(F.min("ms").alias("start_ms"), F.max("ms").alias("last_ms"), F.count("*").alias("n")).drop("session_window")


@query("sliding_windows", _CLIPS_SQL + """
, w AS (SELECT event_type, unnest([ms // 1800000 - 1, ms // 1800000]) AS half FROM e)
SELECT event_type, half * 1800000 AS start_ms, count(*) AS n FROM w GROUP BY event_type, half""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of an hour, a new one every half hour."""
    e = events_as_intervals(spark, sf_dir).select("event_type", F.timestamp_millis("start_ms").alias("at"))
    counted = e.groupBy("event_type", F.window("at", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return counted.select("event_type", F.unix_millis("w.start").alias("start_ms"), "n")


@query("asof_join", _CLIPS_SQL + """
, c AS (SELECT * FROM e WHERE event_type = 'click'), p AS (SELECT * FROM e WHERE event_type = 'purchase')
SELECT c.event_id, coalesce(p.event_id, -1) AS purchase_id, coalesce(c.ms - p.ms, -1) AS age_ms FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ms >= p.ms""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of its user at or before every click: both sides in one order, in two levels, no pairs."""
    e = events_as_intervals(spark, sf_dir).filter("event_type in ('click', 'purchase')")
    is_purchase = F.col("event_type") == "purchase"
    order = ["start_ms", F.when(is_purchase, 0).otherwise(1), "event_id"]
    seen = Running(F.when(is_purchase, F.struct("event_id", "start_ms")), "last")
    found = running(stretched(e, ["user_id"], order), ["user_id"], order, {"p": seen}).filter(~is_purchase)
    return found.select(
        "event_id", F.coalesce("p.event_id", F.lit(-1)).alias("purchase_id"),
        F.coalesce(F.col("start_ms") - F.col("p.start_ms"), F.lit(-1)).alias("age_ms"),
    )
