"""Joins, merges, unions and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..sources.tables import load
from .registry import query


@query("scan_project", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07""")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pruned, filtered scan: both predicates reach the file reader."""
    wanted = load(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & F.col("l_discount").between(0.05, 0.07))
    return wanted.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("equi_join_inner", """
SELECT user_id, a.ts::DATE::VARCHAR AS day, count(*) AS pairs FROM events a JOIN events b USING (user_id)
WHERE a.ts::DATE = b.ts::DATE AND a.event_type = 'click' AND b.event_type = 'purchase' GROUP BY user_id, day""")
def equi_join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with purchases of the same user and day, on the composite key."""
    e = load(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").cast("string").alias("day"), "event_type")
    joined = e.filter("event_type = 'click'").drop("event_type").join(e.filter("event_type = 'purchase'").drop("event_type"), ["user_id", "day"])
    return joined.groupBy("user_id", "day").agg(F.count("*").alias("pairs"))


@query("equi_join_left", """
SELECT doc_id, source, coalesce(quality, -1) AS quality, quality IS NULL AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)""")
def equi_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = docs.join(labels, "doc_id", "left").withColumn("unlabelled", F.col("quality").isNull())
    return joined.withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("full_outer_coalesce", """
WITH l AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END AS name FROM documents),
r AS (SELECT vec_id AS doc_id, 'label ' || label AS name FROM embeddings)
SELECT doc_id, coalesce(nullif(l.name, ''), r.name) AS name FROM l FULL JOIN r USING (doc_id)""")
def full_outer_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of documents, some of them blank, and of vectors, under one numbering."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source")).alias("name"))
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("label "), "label").alias("name"))
    return rel.merge_prefer_left(docs, vectors, "doc_id", ["name"])


@query("semi_join_filter", """
SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount = 0)""")
def semi_join_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    some = items.filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    none = items.filter("l_discount = 0").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(some, "o_orderkey", "left_semi").join(none, "o_orderkey", "left_anti")


@query("explode_join", """
WITH s AS (SELECT n_nationkey, n_name, unnest([n_nationkey % 5, (n_nationkey + 2) % 5]) AS r, unnest([1, 2]) AS place FROM nation)
SELECT n_nationkey, place, r_name, n_name FROM s JOIN region ON r = r_regionkey""")
def explode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of references taken apart and joined, its order kept as a column."""
    refs = F.array(F.col("n_nationkey") % 5, (F.col("n_nationkey") + 2) % 5)
    pulled = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.posexplode(refs).alias("place", "r_regionkey"))
    return pulled.join(load(spark, sf_dir, "region"), "r_regionkey").select("n_nationkey", (F.col("place") + 1).alias("place"), "r_name", "n_name")


@query("priority_lookup_join", """
WITH t AS (SELECT doc_id, unnest([doc_id + 1, doc_id - 1, doc_id]) AS k, unnest([0, 1, 2]) AS rank FROM documents),
h AS (SELECT t.doc_id, k, rank, quality FROM t JOIN labels ON labels.doc_id = k),
b AS (SELECT doc_id, arg_min(k, rank) AS found, arg_min(quality, rank) AS value FROM h GROUP BY doc_id)
SELECT documents.doc_id, coalesce(found, -1) AS found, coalesce(value, -1) AS value FROM documents LEFT JOIN b USING (doc_id)""")
def priority_lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the next document, else of the one before, else its own."""
    order = F.array(F.col("doc_id") + 1, F.col("doc_id") - 1, F.col("doc_id"))
    found = rel.priority_lookup(load(spark, sf_dir, "documents"), "doc_id", order, load(spark, sf_dir, "labels"), "doc_id", "quality")
    return found.na.fill(-1, ["found", "value"])


@query("distinct_join_back", """
WITH w AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source)
SELECT doc_id, source, doc_id = first AS worked, CASE WHEN first % 2 = 0 THEN 'ok' ELSE 'failed' END AS status FROM documents JOIN w USING (source)""")
def distinct_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work done once for each different source, its outcome joined back to every row."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    done = rel.work_list(docs, "source", "doc_id").withColumn("status", F.when(F.col("first") % 2 == 0, "ok").otherwise("failed"))
    return docs.join(done, "source").select("doc_id", "source", (F.col("doc_id") == F.col("first")).alias("worked"), "status")


@query("dedup_last_wins", """
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type""")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return rel.last_wins(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("merge_dedup_last_wins", """
WITH c AS (SELECT 1 AS chunk, doc_id, source || ':a' AS value FROM documents UNION ALL SELECT 2, doc_id, quality || ':b' FROM labels UNION ALL SELECT 3, vec_id, label || ':c' FROM embeddings)
SELECT doc_id, arg_max(value, chunk) AS value, max(chunk)::INTEGER AS chunk, count(*) AS copies FROM c GROUP BY doc_id""")
def merge_dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of results merged; a later chunk overrides, and how many had the key is kept."""
    parts = [("documents", "doc_id", "source", "a"), ("labels", "doc_id", "quality", "b"), ("embeddings", "vec_id", "label", "c")]
    chunks = None
    for i, (name, key, value, tag) in enumerate(parts, 1):
        own = load(spark, sf_dir, name).select(F.lit(i).alias("chunk"), F.col(key).alias("doc_id"), F.concat(F.col(value).cast("string"), F.lit(f":{tag}")).alias("value"))
        chunks = own if chunks is None else chunks.unionByName(own)
    return chunks.groupBy("doc_id").agg(F.max_by("value", "chunk").alias("value"), F.max("chunk").alias("chunk"), F.count("*").alias("copies"))


@query("union_tagged", """
SELECT 'rich' AS tier, c_custkey FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'poor', c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'builder', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""")
def union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer")
    parts = {"rich": "c_acctbal > 9000", "poor": "c_acctbal < 0", "builder": "c_mktsegment = 'BUILDING'"}
    return rel.tagged_union({name: rows.filter(rule).select("c_custkey") for name, rule in parts.items()}, "tier")


@query("unpivot_scopes", """
SELECT doc_id, scope, size FROM (SELECT doc_id, unnest(['current', 'history', 'plus']) AS scope, unnest([n_chars, n_chars // 2, n_chars * 2]) AS size FROM
  (SELECT source, arg_min(doc_id, doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source))""")
def unpivot_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of every source as three rows, one per scope."""
    first = load(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", "doc_id").alias("n"))
    wide = first.select("doc_id", F.col("n").alias("current"), F.floor(F.col("n") / 2).alias("history"), (F.col("n") * 2).alias("plus"))
    return wide.unpivot("doc_id", ["current", "history", "plus"], "scope", "size")


@query("group_collect_sorted", """
SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name)), ',') AS names, count(*) AS n FROM part GROUP BY p_brand""")
def group_collect_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("names"), F.count("*").alias("n"))


@query("ordered_string_agg", """
SELECT conv_id, string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")
def ordered_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), "role", F.lit(": "), "text")
    in_order = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda s: s["line"]), "\n").alias("transcript"))


@query("dim_lookup", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'works' WHEN 'AUTOMOBILE' THEN 'cars' WHEN 'MACHINERY' THEN 'works' ELSE 'other' END AS branch FROM customer""")
def dim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal lookup table, broadcast, with a default."""
    table = spark.createDataFrame([("BUILDING", "works"), ("AUTOMOBILE", "cars"), ("MACHINERY", "works")], "c_mktsegment string, branch string")
    joined = load(spark, sf_dir, "customer").join(F.broadcast(table), "c_mktsegment", "left")
    return joined.select("c_custkey", F.coalesce("branch", F.lit("other")).alias("branch"))
