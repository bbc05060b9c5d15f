"""Operator 1, quality classifier: nearest-neighbour voting in a latent semantic space.

A text is a vector of hashed terms: its words, their shapes (first and last character class, case,
length) and its repetitions (words inside 3-word windows seen before, lines seen before). Term
frequencies are damped by a logarithm, weighted by inverse document frequency and normalised. A
truncated SVD of the labelled texts gives the latent space; every text is projected onto it and
compared, by exact cosine products in blocks, with all labelled vectors. The ``neighbours`` nearest
vote with the fourth power of their similarity; a small prior keeps texts without a neighbour near the share
of good labels.

The classifier is fitted on at most ``max_labelled`` labelled rows, those with the smallest id
hashes, so that what is broadcast has a fixed size: max_labelled x dimensions labelled vectors and
terms x dimensions directions. Every document is scored, its whole text, without a shuffle.

Defined results for odd input: a null or blank text has no terms and scores the prior; labels that are
null are not used; of clashing labels of one doc_id the least counts; documents that share a doc_id
are labelled rows each, the bound holds for rows; neighbours tied for the last place share it;
without labels every score is 0.5; repeated rows are scored one by one; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, table
from .wordblocks import U64, Words, WordReader, doc_offsets, mix64, window_hashes

MAX_LABELLED = 5000
WORD_TERMS = 3072
SHAPE_TERMS = 1000
TERMS = WORD_TERMS + SHAPE_TERMS + 2
DIMENSIONS = 64
NEIGHBOURS = 25
PRIOR_WEIGHT = 0.05
GOOD_AT = 0.7
#: Coordinates are whole multiples of 1 / GRID: sums of their products are exact in a double, however many rows are multiplied at once.
GRID = 2.0**20


def _character_classes() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 beyond ASCII, and every other ASCII character by itself."""
    out = np.arange(256, dtype=np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 3
    return out


def term_counts(words: Words, classes: np.ndarray) -> np.ndarray:
    """Term counts of some documents, float32 of shape (documents, TERMS)."""
    n = words.n_docs
    counts = np.zeros(n * TERMS, np.float32)

    def add(doc: np.ndarray, term: np.ndarray) -> None:
        np.add(counts, np.bincount(doc * TERMS + term, minlength=n * TERMS), out=counts, casting="unsafe")

    if len(words.start):
        add(words.doc, (words.hash % U64(WORD_TERMS)).astype(np.int64))
        length = words.end - words.start
        first, last = classes[words.data[words.start]], classes[words.data[words.end - 1]]
        inner = classes[words.data[words.start + length // 2]]
        shape = (first * 256 + last) * 1024 + inner * 4 + np.minimum(length // 8, 3)
        add(words.doc, WORD_TERMS + (mix64(shape.astype(U64)) % U64(SHAPE_TERMS)).astype(np.int64))
        doc, window = window_hashes(words, 3)
        for term, (d, h) in enumerate(((doc, window), line_hashes(words))):
            repeated = len(d) and _seen_before(d, h)
            if np.any(repeated):
                add(d[repeated], np.full(int(repeated.sum()), WORD_TERMS + SHAPE_TERMS + term))
    return counts.reshape(n, TERMS)


def line_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash of the words) of every line with a word."""
    breaks = np.flatnonzero(words.data == 10)
    line = np.searchsorted(breaks, words.start)
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1])
    at = np.flatnonzero(new)
    place = np.arange(len(line)) - np.repeat(at, np.diff(np.append(at, len(line))))
    with np.errstate(over="ignore"):
        return words.doc[at], np.add.reduceat(mix64(words.hash + place.astype(U64) * U64(0x9E3779B97F4A7C15)), at)


def _seen_before(doc: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(doc)), hashed, doc))
    again = np.zeros(len(doc), bool)
    again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (hashed[order[1:]] == hashed[order[:-1]])
    return again


class Model(NamedTuple):
    idf: np.ndarray  # TERMS
    directions: np.ndarray  # TERMS x DIMENSIONS
    vectors: np.ndarray  # labelled rows x DIMENSIONS, of length 1
    labels: np.ndarray
    prior: float


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), np.float32(1e-9))[:, None]
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _grid(x: np.ndarray) -> np.ndarray:
    x = x * GRID if x.dtype == np.float64 else x.astype(np.float64) * GRID
    np.rint(x, out=x)
    x /= GRID
    return x


def _collect_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, classes = WordReader(), _character_classes()
    for batch in batches:
        for first, words in reader.pieces(batch.column(1)):
            counts = term_counts(words, classes)
            doc, term = np.nonzero(counts)
            ends = pa.array(doc_offsets(doc, words.n_docs), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2).slice(first, words.n_docs),
                    batch.column(0).slice(first, words.n_docs).cast(pa.float64()),
                    pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(counts[doc, term])),
                ],
                ["key", "label", "term", "n"],
            )


def fit(labelled: DataFrame, dimensions: int = DIMENSIONS) -> Model | None:
    """The model of (label, text); ``labelled`` is a bounded sample, its terms reach the driver."""
    rows = labelled.select("label", "text", F.xxhash64("text", "label").alias("key"))
    found = rows.mapInArrow(_collect_terms, "key long, label double, term array<int>, n array<float>").toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by("key").drop_columns("key")  # one order, however the rows were dealt
    labels = found.column("label").to_numpy().astype(np.float32)
    x, at = np.zeros((len(labels), TERMS), np.float32), 0
    for batch in found.to_batches():
        lengths = batch.column(1).value_lengths().to_numpy()
        x[np.repeat(np.arange(at, at + len(lengths)), lengths), batch.column(1).flatten().to_numpy()] = batch.column(2).flatten().to_numpy()
        at += len(lengths)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.2).astype(np.float32)
    x = _weighted(x, idf)
    rank = min(dimensions, len(x))
    probe = np.random.default_rng(20).standard_normal((TERMS, min(rank + 16, len(x)))).astype(np.float32)
    basis = x @ probe
    for _ in range(3):  # power iterations of the randomised SVD
        basis = x @ (x.T @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    directions = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:rank].T
    directions = np.ascontiguousarray(_grid(directions))
    return Model(idf, directions, _grid(_unit(_grid(x) @ directions)), labels, float(labels.mean()))


def vote(model: Model, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of documents by their term counts: exact products with all labelled vectors."""
    projected = _grid(_unit(_grid(_weighted(counts, model.idf)) @ model.directions))
    products = projected @ model.vectors.T
    k = min(neighbours, products.shape[1])
    last = np.partition(products, products.shape[1] - k, axis=1)[:, products.shape[1] - k :].min(axis=1, keepdims=True)
    weight = np.where(products >= last, np.maximum(products, 0), 0).astype(np.float64) ** 4
    tied = products == last
    n_tied = tied.sum(axis=1, keepdims=True)
    if (n_tied > 1).any():
        places = k - (products > last).sum(axis=1, keepdims=True)
        weight *= np.where(tied, places / n_tied, 1)
    score = weight @ model.labels.astype(np.float64) + PRIOR_WEIGHT * model.prior
    return np.clip(score / (weight.sum(axis=1) + PRIOR_WEIGHT), 0.0, 1.0)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, classes = WordReader(), _character_classes()
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, words in reader.pieces(batch.column(1)):
                for low in range(0, words.n_docs, 512):
                    some = _documents(words, low, min(low + 512, words.n_docs))
                    out[first + low : first + low + some.n_docs] = vote(model, term_counts(some, classes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return run


def _documents(words: Words, low: int, high: int) -> Words:
    if low == 0 and high == words.n_docs:
        return words
    a, b = np.searchsorted(words.doc, [low, high])
    return Words(words.data, words.doc[a:b] - low, words.start[a:b], words.end[a:b], words.hash[a:b], high - low)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(label, text) of at most ``max_labelled`` labelled documents outside the held-out quarter."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc32_mod("doc_id", 4) != 2))
    least = usable.groupBy(F.col("doc_id").alias("__ls_id")).agg(F.min(F.col("quality").cast("double")).alias("label"))
    order = [F.xxhash64("__ls_id"), F.col("__ls_id")]
    chosen = least.orderBy(*order).limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__ls_id"))
    return rows.orderBy(*order, F.xxhash64("text")).limit(max_labelled).select("label", "text")


def classify_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", "text")
    if model is None:
        return plain.select("doc_id", F.lit(0.5).alias("score"))
    return plain.mapInArrow(_score(model), f"doc_id {kind}, score double")


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify_quality(docs, fit(labelled_sample(docs, table(spark, sf_dir, "labels"))))
    return scored.select(
        "doc_id",
        (crc32_mod("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= GOOD_AT).cast("int").alias("predicted"),
    )
