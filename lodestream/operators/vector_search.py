"""Cosine search without pair rows: products of blocks of queries with Arrow batches of vectors.

The queries are a stated set and come in blocks of ``BLOCK_QUERIES``, one pass over the vectors for
each; a task gives out its best rows for each query. Vectors of length zero or null match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_QUERIES = 1000
CHUNK_ROWS = 1024
HASH_SPAN = 1 << 52


class Pick(NamedTuple):
    """What to find: the k most or least similar vectors, or the next ones on a ring of hashes.

    ``skip`` leaves out rows that equal the query in a mark: ``id`` or ``label``.
    """

    name: str
    k: int
    by: str = "most"
    skip: Sequence[str] = ("id",)


def ring_position(key) -> F.Column:
    """A 52-bit number from the md5 of a key's text."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("long")


def _unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length 1, which rows have a direction)."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    x = np.array([v if v is not None and len(v) == width else [0.0] * width for v in vectors], np.float64).reshape(len(vectors), width)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm > 0


def _search(block: list, picks: Sequence[Pick], id_type: pa.DataType, query_type: pa.DataType):
    ids = [r["query"] for r in block]
    directions, usable = _unit([r["vector"] for r in block])
    marks = {"id": ids, "label": [r["label"] for r in block]}
    ring = np.array([r["ring"] for r in block], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK_ROWS):
                some = batch.slice(low, CHUNK_ROWS)
                row_ids, labels = some.column(0).to_pylist(), some.column(1).to_pylist()
                x, good = _unit(some.column(2).to_pylist())
                if not x.shape[1]:
                    continue
                cosines = np.round(x @ directions.T, 6)
                ok = good[:, None] & usable[None, :]
                own = {"id": row_ids, "label": labels}
                same = {m: np.array(own[m], object)[:, None] == np.array(marks[m], object)[None, :] for m in ("id", "label")}
                for p, pick in enumerate(picks):
                    if pick.by == "ring":
                        value = -((np.array(some.column(3).to_numpy())[:, None] - ring[None, :]) % HASH_SPAN).astype(np.float64)
                    else:
                        value = cosines if pick.by == "most" else -cosines
                    allowed = ok.copy()
                    for m in pick.skip:
                        allowed &= ~same[m].astype(bool)
                    for q in range(len(ids)):
                        at = np.flatnonzero(allowed[:, q])
                        if len(at) > pick.k:
                            cut = np.partition(value[at, q], len(at) - pick.k)[len(at) - pick.k]
                            at = at[value[at, q] >= cut]
                        best = held.setdefault((p, q), [])
                        best += [(-value[i, q], row_ids[i], labels[i], cosines[i, q]) for i in at]
                        if len(best) > pick.k:
                            best.sort(key=lambda b: b[:2])
                            del best[pick.k :]
        rows = [(ids[q], picks[p].name, *b[1:], b[0]) for (p, q), best in held.items() for b in best]
        kinds = (query_type, pa.string(), id_type, pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["query", "pick", "id", "label", "score", "__order"]
        )

    return run


def find_vectors(rows: DataFrame, queries: DataFrame, picks: Sequence[Pick]) -> DataFrame:
    """(query, pick, id, label, score, rank) of the rows that each pick finds for each query.

    ``rows`` is (id, label, vector), ``queries`` (query, label, vector); ties go to the lesser id.
    """
    from .retrieval import top_k

    plain = rows.select("id", F.col("label").cast("long").alias("label"), "vector", ring_position(F.col("id")).alias("ring"))
    asked = queries.select("query", F.col("label").cast("long").alias("label"), "vector", ring_position(F.concat(F.lit("q"), F.col("query").cast("string"))).alias("ring"))
    kind = {name: df.schema[name].dataType for df, name in ((plain, "id"), (asked, "query"))}
    schema = f"query {kind['query'].simpleString()}, pick string, id {kind['id'].simpleString()}, label long, score double, __order double"
    found, block = None, []

    def flush() -> None:
        nonlocal found, block
        if block:
            some = plain.mapInArrow(_search(block, picks, to_arrow_type(kind["id"]), to_arrow_type(kind["query"])), schema)
            found = some if found is None else found.union(some)
        block = []

    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK_QUERIES:
            flush()
    flush()
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    ranked = top_k(found, ["query", "pick"], max(p.k for p in picks), F.col("__order"), F.col("id"))
    allowed = F.create_map(*[x for p in picks for x in (F.lit(p.name), F.lit(p.k))])
    return ranked.filter(F.col("rank") <= F.element_at(allowed, F.col("pick"))).drop("__order")
