"""Selection queries: top-k in groups, quotas, stages, spacing, rotation and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.decisions import reasons
from ..functions.timefns import day_period
from ..operators.diversity import category_pattern_select, spaced_select
from ..operators.retrieval import top_k
from ..operators.selection import even_sample, numbered, priority_stages, quota_with_backfill, round_robin
from ..sources.tables import events_as_intervals, load
from .registry import query


@query("topk_per_group", """
SELECT user_id, event_id, n::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 8""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "events"), ["user_id"], 8, F.desc("value"), F.col("event_id"), rank="n").select("user_id", "event_id", "n")


@query("top1_per_group", """
SELECT user_id, event_type, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id, event_type""")
def top1_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of a group, by an aggregate that needs no sort; ties go to the first id."""
    best = F.max_by("event_id", F.struct("value", -F.col("event_id")))
    return load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(best.alias("event_id"), F.max("value").alias("value"))


@query("lexi_topk", """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderpriority, o_orderdate DESC, o_totalprice DESC, o_orderkey LIMIT 25""")
def lexi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by several keys at once; a bounded heap per task, no global sort."""
    eligible = load(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    order = [F.col("o_orderpriority"), F.desc("o_orderdate"), F.desc("o_totalprice"), F.col("o_orderkey")]
    return eligible.orderBy(*order).limit(25).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("weighted_score_topk", """
WITH s AS (SELECT doc_id, 5 * (lang = 'en')::INTEGER + 3 * (n_chars BETWEEN 500 AND 2000)::INTEGER + 2 * (text LIKE '%the%')::INTEGER - 4 * (text LIKE '%|%')::INTEGER AS score,
  concat_ws(' | ', CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN n_chars BETWEEN 500 AND 2000 THEN 'fit length' END, CASE WHEN text LIKE '%|%' THEN 'table rests' END) AS why FROM documents)
SELECT doc_id, score::INTEGER AS score, why, n::INTEGER AS n FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS n FROM s) WHERE n <= 20""")
def weighted_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for what speaks for a document, the reasons, and the best twenty."""
    english, fits = F.col("lang") == "en", F.col("n_chars").between(500, 2000)
    has_the, table_rests = F.col("text").contains("the"), F.col("text").contains("|")
    score = 5 * english.cast("int") + 3 * fits.cast("int") + 2 * has_the.cast("int") - 4 * table_rests.cast("int")
    why = reasons([(english, "english"), (fits, "fit length"), (table_rests, "table rests")])
    best = load(spark, sf_dir, "documents").select("doc_id", score.alias("score"), why.alias("why")).orderBy(F.desc("score"), "doc_id").limit(20)
    return best.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


@query("quota_backfill_select", """
WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events),
g AS (SELECT *, row_number() OVER (ORDER BY (n > ceil(33 / 5.0))::INTEGER, value DESC, event_id) AS k FROM r)
SELECT event_id, event_type, value, row_number() OVER (ORDER BY value DESC, event_id)::INTEGER AS n FROM g WHERE k <= 33""")
def quota_backfill_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """33 rows, at most an equal share per type; what is missing is filled up by value."""
    return quota_with_backfill(load(spark, sf_dir, "events"), "event_type", "value", "event_id", 33).select("event_id", "event_type", "value", "n")


@query("quota_select", """
WITH r AS (SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer),
s1 AS (SELECT c_custkey, 'demo' AS stage FROM r WHERE n = 1),
s2 AS (SELECT c_custkey, 'eval' AS stage FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k FROM r WHERE c_acctbal >= 5000 AND c_custkey NOT IN (SELECT c_custkey FROM s1)) WHERE k <= 25),
s3 AS (SELECT c_custkey, 'control' AS stage FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS k FROM r WHERE c_custkey NOT IN (SELECT c_custkey FROM s1 UNION ALL SELECT c_custkey FROM s2)) WHERE k <= 10)
SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3""")
def quota_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages, none reusing a row of an earlier one: one per segment, the richest, the poorest."""
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    rich = [F.desc("c_acctbal"), F.col("c_custkey")]
    demo = top_k(rows, ["c_mktsegment"], 1, *rich, rank="n").select("c_custkey", F.lit("demo").alias("stage"))
    return priority_stages(
        rows, "c_custkey", demo,
        [("eval", F.col("c_acctbal") >= 5000, rich, 25), ("control", F.lit(True), [F.col("c_acctbal"), F.col("c_custkey")], 10)],
    )


@query("anti_join_priority", """
WITH b AS (SELECT p_partkey, CASE WHEN p_size <= 5 THEN 0 WHEN p_type = 'ECONOMY' THEN 1 WHEN p_retailprice > 1000 THEN 2 ELSE 3 END AS bucket, p_retailprice FROM part)
SELECT bucket, p_partkey, n::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY p_retailprice DESC, p_partkey) AS n FROM b) WHERE n <= 5""")
def anti_join_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each of four buckets in order of priority; a row counts in its first bucket only."""
    bucket = F.when(F.col("p_size") <= 5, 0).when(F.col("p_type") == "ECONOMY", 1).when(F.col("p_retailprice") > 1000, 2).otherwise(3)
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_retailprice", bucket.alias("bucket"))
    return top_k(rows, ["bucket"], 5, F.desc("p_retailprice"), F.col("p_partkey"), rank="n").select("bucket", "p_partkey", "n")


@query("even_sample", """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events),
p AS (SELECT DISTINCT user_id, unnest(CASE WHEN m <= 7 THEN range(m) ELSE list_transform(range(7), lambda k: round_even(k * (m - 1) / 6.0, 0)::BIGINT) END) AS i FROM (SELECT DISTINCT user_id, m FROM r))
SELECT user_id, event_id FROM r JOIN p USING (user_id, i)""")
def even_sample_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven events of every user, evenly spaced in order of time, first and last included."""
    return even_sample(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 7).select("user_id", "event_id")


@query("round_robin", """
SELECT place::INTEGER AS place, event_type, event_id FROM (
  SELECT *, row_number() OVER (ORDER BY n, event_type) AS place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 40)
WHERE place <= 40""")
def round_robin_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of every type, then the second of every type and so on, forty in all."""
    return round_robin(load(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], 40).select("place", "event_type", "event_id")


@query("rotation_pick", """
WITH a AS (SELECT conv_id, list_sort(list(DISTINCT turn)) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, t[conv_id % len(t) + 1] AS first_turn, t[(conv_id + len(t) // 2) % len(t) + 1] AS second_turn FROM a""")
def rotation_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two members of a conversation's turns by rotation, half a round apart."""
    turns = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("turn")).alias("t"))
    n = F.size("t")
    at = lambda i: F.get("t", F.pmod(i, n).cast("int"))
    return turns.select("conv_id", at(F.col("conv_id")).alias("first_turn"), at(F.col("conv_id") + F.floor(n / 2)).alias("second_turn"))


@query("id_assign_reuse", """
WITH e AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM labels WHERE quality = 1 AND toxic = 0)
SELECT e.doc_id, coalesce('D_' || lpad(d.n::VARCHAR, 6, '0'), 'E_' || lpad(e.n::VARCHAR, 6, '0')) AS case_id FROM e LEFT JOIN d USING (doc_id)""")
def id_assign_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential ids by length; a document that has an id from an earlier selection, the good labels, keeps it."""
    padded = lambda prefix, c: F.concat(F.lit(prefix), F.lpad(c.cast("string"), 6, "0"))
    by_length = numbered(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), [-F.col("n_chars")], [F.col("doc_id")], "n")
    good = load(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    earlier = numbered(good, [F.floor(F.col("doc_id") / 1000)], [F.col("doc_id")], "own_n")
    ids = by_length.join(earlier, "doc_id", "left")
    return ids.select("doc_id", F.coalesce(padded("D_", F.col("own_n")), padded("E_", F.col("n"))).alias("case_id"))


@query("diverse_select")
def diverse_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six windows of every user: one per period on days of their own, then spaced by half an hour."""
    clips = events_as_intervals(spark, sf_dir).withColumn("period", day_period("sod_ms"))
    return spaced_select(clips, "user_id", "event_id", "start_ms", "day", "period", 6, 1_800_000)


@query("diverse_category_select")
def diverse_category_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty documents: new source and language first, then either new, then any, by length."""
    return category_pattern_select(load(spark, sf_dir, "documents"), "doc_id", "n_chars", "source", "lang", 30)
