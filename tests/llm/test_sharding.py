import struct
import zlib
from collections import Counter

import pytest
import xxhash
from helpers import docs, documents

from lodestream.llm import sharding as sh


def jump(key, n):
    """The published loop."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sh.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def spark_hash(value):
    return 42 if value is None else xxhash.xxh64(struct.pack("<q", value), seed=42).intdigest()


def check(rows, texts, n=40):
    for r in rows:
        body = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 16, zlib.crc32(body))
        assert (r["shard"], r["grown_shard"]) == (jump(spark_hash(r["doc_id"]), n), jump(spark_hash(r["doc_id"]), n + 1))
    slots = Counter((r["shard"], r["slot"]) for r in rows)
    assert max(slots.values(), default=1) == 1
    for shard, count in Counter(r["shard"] for r in rows).items():
        assert {s for k, s in slots if k == shard} == set(range(count))


def test_whole_table_against_the_published_loop(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows, pdf = sh.op9_sharding(spark, sf).collect(), documents(spark, sf)
    assert len(rows) == len(pdf) and {r["law"] for r in rows} == {"key"}
    check(rows, dict(zip(pdf.doc_id, pdf.text)))
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert moved and {r["grown_shard"] for r in moved} == {40}


@pytest.mark.parametrize("n", [1, 7, 96, 97, 5000])
def test_any_number_of_shards(spark, n):
    keys = [*range(300), -1, 2**62, -(2**63), 2**63 - 1]
    df = sh.assign_shards(docs(spark, [(k, "") for k in keys]), "doc_id", n)
    for r in df.collect():
        assert (r["shard"], r["grown_shard"]) == (jump(spark_hash(r["doc_id"]), n), jump(spark_hash(r["doc_id"]), n + 1))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 5000), (3, "é" * 5000), (None, "x"), (None, "x")]
    df = docs(spark, rows).withColumn("slot", sh.F.lit("clash")).withColumn("shard", sh.F.lit("clash"))
    got = sh.shard_rows(df, blocks=4).collect()
    assert len(got) == len(rows)
    check(got, dict(rows))
    assert sh.shard_rows(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sh.assign_shards(df, "doc_id", 0)
