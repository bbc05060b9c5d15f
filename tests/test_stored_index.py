"""The stored index against a full scan."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import stored_index as si
from lodestream.operators.retrieval import bm25_best, blank_words
from lodestream.plans.indexed import index_of_documents
from lodestream.sources.tables import contents_key


def texts(rng, n, words=400):
    names = [f"t{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [" ".join(rng.choices(names, weights, k=rng.randrange(1, 80))) for _ in range(n)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def corpus(spark):
    rng = random.Random(6)
    body = texts(rng, 1500)
    docs = spark.createDataFrame([(i, t, f"s{i % 7}") for i, t in enumerate(body)] + [(9000, None, "s1"), (9001, "", None), (9002, body[3], "s3")], "doc_id long, text string, source string")
    asked = [(i, " ".join(body[i * 31].split()[:12]) + " unheard", [f"s{i % 7}", "s2"] if i % 3 else None) for i in range(40)] + [(77, "", None), (78, None, ["s1"]), (79, "nothing known", None)]
    return docs, spark.createDataFrame(asked, "item_id long, text string, pool array<string>")


@pytest.mark.parametrize("block, shard", [(si.BLOCK, si.SHARD_DOCS), (8, 100)])
def test_equals_a_full_scan(spark, corpus, tmp_path, monkeypatch, block, shard):
    docs, queries = corpus
    monkeypatch.setattr(si, "BLOCK", block)
    monkeypatch.setattr(si, "SHARD_DOCS", shard)
    monkeypatch.setattr(si, "CELLS", 30 * shard)
    si.build_index(docs, f"{tmp_path}/i", "doc_id", group="source")
    for k in (1, 5, 60):
        for pool in (None, "pool"):
            got = si.search(spark, f"{tmp_path}/i", queries, "item_id", k, pool=pool).best()
            want = bm25_best(docs, queries, "doc_id", "item_id", k, source="source", pool=pool)
            assert rows_of(got.select("query", "doc", "score", "rank")) == rows_of(want.select("item_id", "doc_id", "score", "rank"))


def test_okapi_form(spark, corpus, tmp_path):
    docs, queries = corpus
    si.build_index(docs, f"{tmp_path}/i", "doc_id", tokenise=blank_words)
    got = si.search(spark, f"{tmp_path}/i", queries, "item_id", 5, okapi=True, tokenise=blank_words).best()
    want = bm25_best(docs, queries, "doc_id", "item_id", 5, okapi=True, tokenise=blank_words)
    assert rows_of(got.select("query", "doc", "score", "rank")) == rows_of(want.select("item_id", "doc_id", "score", "rank"))


def test_passes_over_blocks(spark, corpus, tmp_path, monkeypatch):
    """Queries of one word read few of the postings of it, and find the same."""
    docs, _ = corpus
    monkeypatch.setattr(si, "BLOCK", 8)
    monkeypatch.setattr(si, "SHARD_DOCS", 100)
    queries = spark.createDataFrame([(i, f"t{i}") for i in range(30)], "item_id long, text string")
    si.build_index(docs, f"{tmp_path}/i", "doc_id")
    found = si.search(spark, f"{tmp_path}/i", queries, "item_id", 3)
    want = bm25_best(docs, queries, "doc_id", "item_id", 3)
    assert rows_of(found.best().select("query", "doc", "score", "rank")) == rows_of(want.select("item_id", "doc_id", "score", "rank"))
    read = found.blocks_read().agg({"postings_read": "sum", "n_postings": "sum", "blocks_read": "sum", "n_blocks": "sum"}).first()
    assert 0 < read["sum(postings_read)"] < 0.6 * read["sum(n_postings)"]
    assert read["sum(blocks_read)"] < 0.8 * read["sum(n_blocks)"]


def test_an_index_is_written_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    key = contents_key(spark, str(tmp_path), "documents")
    path = index_of_documents(spark, str(tmp_path))
    written = spark.read.parquet(f"{path}/totals").inputFiles()
    assert index_of_documents(spark, str(tmp_path)) == path and spark.read.parquet(f"{path}/totals").inputFiles() == written
    docs.union(docs).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert contents_key(spark, str(tmp_path), "documents") != key
    assert index_of_documents(spark, str(tmp_path)) != path


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_shuffled_and_not_postings(spark, tmp_path):
    rng = random.Random(2)
    body = [" ".join(map(str, rng.sample(range(1000, 2000), 300))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(body)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    before = shuffled_bytes(spark)
    si.build_index(spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/i", "doc_id")
    assert shuffled_bytes(spark) - before < sum(map(len, body))


def test_only_blocks_of_a_pool_are_shuffled(spark, tmp_path):
    """Questions with one group each take the blocks of that group alone; a pool of null takes all, each once."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 60}" for j in range(40)), f"g{i % 10}") for i in range(600)], "doc_id long, text string, source string")
    si.build_index(docs, f"{tmp_path}/i", "doc_id", group="source")
    asked = [(i, f"w{i} w{i + 1}", [f"g{i}"]) for i in range(6)] + [(9, "w50", None), (10, "w50 w51", ["g3", "g4"])]
    queries = spark.createDataFrame(asked, "item_id long, text string, pool array<string>")
    found = si.search(spark, f"{tmp_path}/i", queries, "item_id", 4, pool="pool")
    blocks = found.blocks.select("shard", "term", "grp", "n")
    everything = rows_of(blocks)
    wanted = {(t, g) for _, text, pool in asked for t in text.split() for g in (pool or [f"g{i}" for i in range(10)])}
    taken = rows_of(si._met(found.blocks, found.needed.withColumn("need", F.lit(0.0))).select("shard", "term", "grp", "n"))
    assert taken == [r for r in everything if (r[1], r[2]) in wanted] and len(taken) < len(everything) / 10
    assert {(r["term"], r["grp"]) for r in found.read.select("term", "grp").collect()} <= wanted
    want = bm25_best(docs, queries, "doc_id", "item_id", 4, source="source", pool="pool")
    assert rows_of(found.best().select("query", "doc", "score", "rank")) == rows_of(want.select("item_id", "doc_id", "score", "rank"))


def test_a_shard_is_full_by_its_postings(spark, tmp_path, monkeypatch):
    """Long texts make a shard full before it has all its documents; every posting is in one block of a known size."""
    monkeypatch.setattr(si, "SHARD_POSTINGS", 500)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 37 + j) % 900}" for j in range(300)), f"g{i % 2}") for i in range(40)], "doc_id long, text string, source string").coalesce(1)
    si.build_index(docs, f"{tmp_path}/i", "doc_id", group="source")
    blocks = spark.read.parquet(f"{tmp_path}/i/blocks").selectExpr("shard", "held", "size(docs) AS n").collect()
    assert all(r["held"] == r["n"] <= si.BLOCK for r in blocks) and sum(r["n"] for r in blocks) == 40 * 300
    per = {}
    for r in blocks:
        per[r["shard"]] = per.get(r["shard"], 0) + r["n"]
    assert max(per.values()) < 500 + 300


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    si.build_index(none, f"{tmp_path}/none", "doc_id")
    assert si.search(spark, f"{tmp_path}/none", some, "item_id", 3).best().count() == 0
    si.build_index(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), f"{tmp_path}/one", "doc_id")
    assert si.search(spark, f"{tmp_path}/one", some.limit(0), "item_id", 3).best().count() == 0
    assert not si.is_built(spark, f"{tmp_path}/absent")
