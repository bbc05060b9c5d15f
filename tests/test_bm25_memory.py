"""What a task of a BM25 scan holds does not grow with the rows of an Arrow batch."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lodestream.operators import retrieval as bm
from lodestream.operators import stored_index as si

WORDS = [f"w{i}" for i in range(400)]


def batch(rows):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=200)) for _ in range(100)]
    return pa.RecordBatch.from_arrays([pa.array([texts[i % 100] for i in range(rows)]), pa.array(["s"] * rows), pa.array(range(rows))], ["text", "source", "doc_id"])


def peak(run, rows):
    given = batch(rows)
    tracemalloc.start()
    out = list(run(iter([given])))
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return size, sum(b.num_rows for b in out)


def runs():
    block = bm._Block([(i, " ".join(WORDS[i : i + 60]), None) for i in range(100)], True, bm.alnum_words)
    weights = {None: np.random.default_rng(1).random((len(block.vocabulary), 100))}
    fields = [("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())]
    score = bm._score(block, weights, {None: 200.0}, 50, bm.alnum_words, fields)
    return {"count": bm._count_terms(block, bm.alnum_words), "score": score}


@pytest.mark.parametrize("name", ["count", "score"])
def test_a_batch_is_taken_in_portions(name):
    small, large = peak(runs()[name], 3_000), peak(runs()[name], 12_000)
    assert large[0] < 1.5 * small[0] + 10_000_000


def test_an_index_counts_a_batch_in_portions():
    turned = lambda given: (b.select(["doc_id", "source", "text"]) for b in given)
    run = lambda given: si._lengths(bm.alnum_words)(turned(given))
    small, large = peak(run, 3_000), peak(run, 12_000)
    assert large[0] < 1.5 * small[0] + 5_000_000


def test_an_index_is_written_in_portions(monkeypatch):
    """Neither a larger batch nor more shards make a task that writes an index hold more."""
    monkeypatch.setattr(si, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(bm, "PORTION", 500_000)
    given = {rows: batch(rows).select(["doc_id", "source", "text"]) for rows in (3_000, 12_000)}
    found = {}
    for rows, whole in given.items():
        tracemalloc.start()
        found[rows] = sum(pc.sum(b.column("held")).as_py() for b in si._shard_blocks(bm.alnum_words, 200.0, 500, 1_000_000, 128)(iter([whole])))
        found[rows, "peak"] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert found[12_000] == 4 * found[3_000] > 0
    assert found[12_000, "peak"] < 1.3 * found[3_000, "peak"] + 1_000_000


def test_portions():
    texts = ["a" * n for n in (900_000, 900_000, 900_000, 5_000_000, 10)] + [None, ""]
    whole = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    parts = list(bm.portions(whole, 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(7))
    assert max(sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) for p in parts) <= 2 * bm.PORTION
    assert len(parts) > 2 and not list(bm.portions(whole.slice(0, 0), 1))
