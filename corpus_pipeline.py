"""A training corpus from raw documents: quality, near duplicates, decontamination, mix, shards.

Every stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept. All
but the last return the columns of their input, whatever these are; the last adds the shard columns.

Defined results for odd input are those of the operators: null and blank texts fail the quality
rules; of rows with equal or near-equal texts one stays; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import checkpointed, table, text_or_empty, word_count
from lodestream.llm.decontaminate import drop_contaminated
from lodestream.llm.mixing import mix
from lodestream.llm.near_dedup import drop_near_duplicates
from lodestream.llm.quality_rules import quality_rules
from lodestream.llm.sharding import shard_rows

N_SHARDS = 40


def _carried(docs: DataFrame, *names: str) -> DataFrame:
    """The columns an operator needs, and the whole row beside them, safe from clashing names."""
    return docs.select(*names, F.struct("*").alias("whole_row"))


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules(_carried(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.filter("kept").select("whole_row.*")


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = _carried(docs, "doc_id", "source").withColumn("n_words", word_count(text_or_empty("whole_row.text")))
    mixed = mix(sized, "n_words").filter("copies > 0")
    return mixed.select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole_row.*")


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard_rows(docs, n_shards=N_SHARDS)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("near_dedup", keep_one_of_each_class),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_into_shards),
]

#: Signatures, edit distances and hashed n-grams have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
