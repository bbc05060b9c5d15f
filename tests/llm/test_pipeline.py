"""The pipeline's stages, each on all its predecessor kept, against plain-Python versions."""

from collections import Counter

import pytest
from helpers import words
from test_mixing import brute_mix
from test_near_dedup import brute_classes
from test_sharding import jump, spark_hash

import corpus_pipeline as cp
from lodestream.llm import decontaminate as dc
from lodestream.llm import quality_rules as q


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """(input rows, output rows) of every stage, written and read between stages as the driver does."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in cp.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        result = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs.columns, docs.collect(), result.columns, result.collect())
        docs = result
    return out


def test_names_and_columns(stages):
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    for name in list(stages)[:-1]:
        assert stages[name][0] == stages[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_rules(spark, sf_dir, stages):
    _, before, _, after = stages["quality_rules"]
    verdict = {r["doc_id"]: r["kept"] for r in q.op10_quality_rules(spark, sf_dir).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if verdict[r["doc_id"]])
    assert 0 < len(after) < len(before)


def test_near_dedup(stages):
    _, before, _, after = stages["near_dedup"]
    classes = brute_classes([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(set(classes))


def test_decontamination(spark, sf_dir, stages):
    _, before, _, after = stages["decontamination"]
    items = [dc.normalise(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in before if any(i in dc.normalise(r["text"]) for i in items)}
    left = {r["doc_id"] for r in after}
    assert not left & leaks
    matcher = dc.Matcher(items, dc.ERROR_RATE)
    assert left == {r["doc_id"] for r in before if not matcher.match(dc.normalise(r["text"]))}


def test_mixing(stages):
    _, before, _, after = stages["mixing"]
    want = brute_mix([(r["doc_id"], len(words(r["text"])), r["source"]) for r in before])
    assert Counter(r["doc_id"] for r in after) == Counter({d: n for d, (_, n) in want.items() if n})


def test_sharding(stages):
    _, before, _, after = stages["sharding"]
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    assert all(r["shard"] == jump(spark_hash(r["doc_id"]), cp.N_SHARDS) for r in after)
    slots = Counter((r["shard"], r["slot"]) for r in after)
    assert max(slots.values()) == 1


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = Counter((r["doc_id"], r["shard"]) for r in cp.run(spark, sf_dir).collect())
    assert got == Counter((r["doc_id"], r["shard"]) for r in stages["sharding"][3])


def test_odd_rows_pass_every_stage(spark, tmp_path):
    good = " ".join(f"word{i % 37}x{i}" for i in range(200))
    rows = [(1, good, "a", 1), (1, good, "a", 1), (None, good + " more", None, 2), (2, None, None, 3), (3, "", "a", 4), (4, "x " * 5000, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int").withColumn("copies", q.F.lit(1)).withColumn("whole", q.F.lit("w"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "some other text entirely here")], "item_id long, text string")
    for name, df in (("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for start in (docs, docs.filter("false")):
        df, counts = start, []
        for i, (_, stage) in enumerate(cp.STAGES):
            stage(spark, df, str(tmp_path)).write.mode("overwrite").parquet(f"{tmp_path}/out{start is docs}{i}")
            df = spark.read.parquet(f"{tmp_path}/out{start is docs}{i}")
            assert set(docs.columns) <= set(df.columns)
            counts.append(df.count())
        assert counts[0] == (3 if start is docs else 0)
