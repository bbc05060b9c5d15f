"""Queries that read a stored BM25 index. The index of a table is written once to the shared folder, under a
key of the table's files, and opened by all later queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import Tokeniser, alnum_words, blank_words
from ..operators.stored_index import build_index, is_built, search
from ..sources.tables import contents_key, load, shared_folder
from . import retrieval  # noqa: F401  (registers the SQL that is used here)
from .registry import ORACLE_SQL, query

_LAYOUTS: dict[str, tuple[str | None, Tokeniser]] = {"words": (None, alnum_words), "by_source": ("source", alnum_words), "blank": (None, blank_words)}


def index_of_documents(spark: SparkSession, sf_dir: str, layout: str = "words") -> str:
    """The folder of the index of ``documents``, which is written if it isn't there."""
    path = f"{shared_folder(spark)}/lodestream-index-by-tasks/{layout}-{contents_key(spark, sf_dir, 'documents')}"
    if not is_built(spark, path):
        group, tokenise = _LAYOUTS[layout]
        build_index(load(spark, sf_dir, "documents"), path, "doc_id", group=group, tokenise=tokenise)
    return path


@query("index_bm25_topk", ORACLE_SQL["bm25_topk"])
def index_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every question, from the stored index."""
    found = search(spark, index_of_documents(spark, sf_dir), load(spark, sf_dir, "benchmark"), "item_id", 5)
    return found.best().select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


@query("index_bm25_pool", ORACLE_SQL["bm25_pool"])
def index_bm25_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each question's pool: only blocks of the pool's sources are read."""
    own = F.concat(F.lit("src"), F.col("item_id") % 20)
    questions = load(spark, sf_dir, "benchmark").withColumn("pool", F.array(own))
    found = search(spark, index_of_documents(spark, sf_dir, "by_source"), questions, "item_id", 10, pool="pool")
    best = found.best().withColumnRenamed("query", "item_id")
    return best.select("item_id", own.alias("source"), F.col("doc").alias("doc_id"), "score", "rank")


@query("index_bm25_okapi", ORACLE_SQL["bm25_okapi"])
def index_bm25_okapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every question by Okapi statistics, from an index of blank-cut words."""
    path = index_of_documents(spark, sf_dir, "blank")
    found = search(spark, path, load(spark, sf_dir, "benchmark"), "item_id", 5, okapi=True, tokenise=blank_words)
    return found.best().select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


@query("index_terms", """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+', 0) AS toks FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM d) GROUP BY doc_id, term),
s AS (SELECT avg(len(toks)) AS mean FROM d)
SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS n_words, round(max(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS top, true AS bounded
FROM p, s GROUP BY term""")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the blocks of the index hold of every term, and whether no block has more than 128 postings."""
    blocks = spark.read.parquet(f"{index_of_documents(spark, sf_dir)}/blocks")
    tf = F.aggregate("docs", F.lit(0).cast("long"), lambda total, p: total + p["tf"])
    size = F.size("docs").cast("long")
    return blocks.groupBy("term").agg(F.sum(size).alias("n_docs"), F.sum(tf).alias("n_words"), F.round(F.max("top"), 6).alias("top"), (F.max(size) <= 128).alias("bounded"))


@query("index_postings_read", """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+', 0) AS toks FROM documents),
f AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS term FROM d) GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+', 0)) AS term FROM benchmark)
SELECT item_id, sum(df)::BIGINT AS n_postings, true AS within FROM q JOIN f USING (term) GROUP BY item_id""")
def index_postings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every question the postings of its terms, and whether the search reads no more than these."""
    found = search(spark, index_of_documents(spark, sf_dir), load(spark, sf_dir, "benchmark"), "item_id", 5)
    return found.blocks_read().select(F.col("query").alias("item_id"), "n_postings", F.col("postings_read").between(1, F.col("n_postings")).alias("within"))
