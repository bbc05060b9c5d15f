"""Operator 3, language identification: word-first backoff.

A word is a run of letters, lower-cased. A word of the model's list scores its log frequency in each
language. Any other word falls back to its character n-grams, edges marked: at every position the
4-gram, or if the model does not know it the 3-gram there, then the 2-gram, then the letter; the
word scores the mean of its positions. A text's score in a language is the sum over its words; the
prediction is the highest, and ``score`` is its share after a softmax over the languages of the
scores divided by the square root of the number of words.

Counts cover every occurrence of every word of every training document, and of its n-grams, so they
do not depend on how the texts are dealt over tasks. Nothing counted is left out of the model: the
words and n-grams above the lowest count at which at most ``max_words`` words and ``max_grams``
n-grams per order remain are sent to the executors, and a document's words on that list are scored
where it is read. Its other words, as a rule few, travel: they are dealt into blocks of about
``BLOCK_BYTES``, and what a block needs beyond the lists is joined to the distributed table of all
other items. Counting is done per task on word hashes first, so only one row per different item and
task is shuffled.

Defined results for odd input: a null text, or one without a letter, is ``und`` with score 0; ties
go to the language first in order; without any training language everything is ``und``; repeated
rows are predicted one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_key, checkpointed, crc32_mod, table, text_or_empty
from .wordblocks import PIECE_BYTES, U64, mix64

MAX_WORDS = 100_000
MAX_GRAMS = 50_000
BLOCK_BYTES = 24 << 20
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
UNDETERMINED = "und"
_EDGE = U64(0x517CC1B727220A95)
_BASE = 0xC2B2AE3D27D4EB4F | 1


class LetterReader:
    """Letter runs of texts as arrays over code points; one per task."""

    def __init__(self) -> None:
        self.letter = np.zeros(sys.maxunicode + 1, bool)
        everything = [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]
        self.letter[[c for c in everything if chr(c).isalpha()]] = True
        self.up = self.down = np.ones(0, U64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, U64(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def pieces(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first document, documents, code points, doc, start, end, hash) of groups of documents."""
        first, held, size = 0, [], 0
        for i, value in enumerate(texts):
            text = (value.as_py() or "").lower()
            held.append(text)
            size += len(text)
            if size >= PIECE_BYTES or i + 1 == len(texts):
                yield first, len(held), *self.words(held)
                first, held, size = i + 1, [], 0

    def words(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        inside = self.letter[points]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        doc = np.searchsorted(offsets, start, "right") - 1
        values = mix64(points.astype(U64) + U64(0x9E3779B97F4A7C15))
        hashed, i, block = np.empty(len(start), U64), 0, 1 << 19
        while i < len(start):
            j = max(int(np.searchsorted(start, start[i] + block)), i + 1)
            at, stop = start[i], end[j - 1]
            self.powers(int(stop - at))
            sums = np.zeros(stop - at + 1, U64)
            np.cumsum(values[at:stop] * self.up[: stop - at], out=sums[1:])
            s, e = start[i:j] - at, end[i:j] - at
            hashed[i:j] = mix64((sums[e] - sums[s]) * self.down[s] + (e - s).astype(U64))
            i = j
        return values, doc, start, end, hashed


def gram_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(word, position of its letters in order, {order: hash}) of the marked words.

    A word of n letters has n + 2 characters with its edges; the n-gram at a position starts there,
    and where the word has too few characters left its hash is 0, which no model holds.
    """
    length = end - start + 2
    word = np.repeat(np.arange(len(start)), length)
    place = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    inner = (place > 0) & (place < length[word] - 1)
    char = np.full(len(word), _EDGE)
    char[inner] = values[start[word[inner]] + place[inner] - 1]
    left = length[word] - place
    out = {}
    for order in ORDERS:
        h = np.zeros(len(word), U64)
        for k in range(order):
            h[: len(h) - k] = (h[: len(h) - k] ^ char[k:]) * U64(0x9FB21C651E98DF25)
            h ^= h >> U64(31)
        h = mix64(h + U64(order))
        h[left < order] = 0
        out[order] = h
    return word, inner | (place == 0), out


def _count(languages: list[str]):
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, size = LetterReader(), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            kind, item, count = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((item, kind))
            kind, item, count = kind[order], item[order], count[order]
            new = np.ones(len(kind), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (item[1:] != item[:-1])
            return kind[new], item[new], np.add.reduceat(count, np.flatnonzero(new)) if len(kind) else count

        for batch in batches:
            langs = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for first, n, values, doc, start, end, hashed in reader.pieces(batch.column(0)):
                lang = langs[first : first + n][doc]
                for code in np.unique(lang):
                    at = np.flatnonzero(lang == code)
                    words, where, times = np.unique(hashed[at], return_index=True, return_counts=True)
                    held.append((np.full(len(words), code), words, times))
                    size += len(words)
                    at = at[where]
                    word, use, grams = gram_hashes(values, start[at], end[at])
                    for order, h in grams.items():
                        own = use & (h != 0)
                        items, again = np.unique(h[own], return_inverse=True)
                        each = np.bincount(again, times[word[own]], len(items)).astype(np.int64)
                        held.append((np.full(len(items), order * len(languages) + code), items, each))
                        size += len(items)
            if size > 3_000_000:  # keeps a task's memory bounded whatever its share of the corpus
                one = merged()
                held, size = [one], len(one[0])
                if size > 1_500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(one[0]), pa.array(one[1].view(np.int64)), pa.array(one[2])], ["kind", "item", "count"])
                    held, size = [], 0
        if held:
            one = merged()
            yield pa.RecordBatch.from_arrays([pa.array(one[0]), pa.array(one[1].view(np.int64)), pa.array(one[2])], ["kind", "item", "count"])

    return run


class Model(NamedTuple):
    """Sorted hashes and their log frequencies by language: of words, and of n-grams by order.

    ``sums`` and ``kinds`` are of all items of an order; ``rest`` is (order, item, by_lang) of those not in ``hashes``.
    """

    languages: list[str]
    hashes: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]
    unseen: np.ndarray
    sums: dict[int, np.ndarray]
    kinds: dict[int, int]
    rest: DataFrame | None


def _logs(by_lang: np.ndarray, sums: np.ndarray, kinds: int) -> np.ndarray:
    return np.log((by_lang + SMOOTHING) / (sums + SMOOTHING * (kinds + 1))).astype(np.float32)


def fit(train: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model | None:
    """The model of (text, lang), both columns without nulls."""
    languages = sorted(r[0] for r in train.select("lang").distinct().collect())
    n = len(languages)
    if not n:
        return None
    counts = train.select("text", "lang").mapInArrow(_count(languages), "kind long, item long, count long")
    summed = counts.groupBy("kind", "item").agg(F.sum("count").alias("count"))
    kind = F.floor(F.col("kind") / n).cast("int")
    lists = F.transform(F.array(*[F.lit(i) for i in range(n)]), lambda i: F.coalesce(F.get(F.col("by_lang"), i), F.lit(0)))
    by_item = checkpointed(
        summed.groupBy(kind.alias("order"), "item").agg(
            F.sum("count").alias("total"),
            F.array(*[F.sum(F.when(F.col("kind") % n == i, F.col("count")).otherwise(0)) for i in range(n)]).alias("by_lang"),
        )
    ).withColumn("by_lang", lists)
    totals = {
        r["order"]: np.array(r["sums"], float)
        for r in by_item.groupBy("order").agg(F.array(*[F.sum(F.get("by_lang", i)) for i in range(n)]).alias("sums")).collect()
    }
    # lowest count at which few enough items remain; a histogram of counts decides it
    steps = by_item.withColumn("step", F.floor(F.log2("total") * 64)).groupBy("order", "step").agg(F.count("*").alias("n")).collect()
    kinds = {order: sum(r["n"] for r in steps if r["order"] == order) for order in (0, *ORDERS)}
    lowest, n_rest = {}, sum(kinds.values())
    for order in totals:
        room = max_words if order == 0 else max_grams
        for r in sorted((r for r in steps if r["order"] == order), key=lambda r: -r["step"]):
            room -= r["n"]
            if room < 0:
                break
            lowest[order] = r["step"]
            n_rest -= r["n"]
    keep: Column = F.lit(False)
    for order, step in lowest.items():
        keep = keep | ((F.col("order") == order) & (F.floor(F.log2("total") * 64) >= step))
    kept = by_item.filter(keep).select("order", "item", "by_lang").toPandas()
    hashes, logs = {}, {}
    for order in (0, *ORDERS):
        own = kept[kept["order"] == order]
        items = own["item"].to_numpy(np.int64).view(U64)
        table_ = np.array(own["by_lang"].tolist(), float).reshape(len(items), n)
        at = np.argsort(items)
        totals.setdefault(order, np.zeros(n))
        hashes[order] = items[at]
        logs[order] = _logs(table_[at], totals[order], kinds[order])
    unseen = _logs(np.zeros(n), totals[1], kinds[1])
    rest = by_item.filter(~keep).select("order", "item", "by_lang") if n_rest else None
    return Model(languages, hashes, logs, unseen, totals, kinds, rest)


def _lookup(model: Model, order: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, row) of hashes in the model's list of an order."""
    own = model.hashes[order]
    if not len(own):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(own, h), len(own) - 1)
    return own[at] == h, at


def score_words(model: Model, values, start, end, hashed) -> np.ndarray:
    """Log score of every word in every language."""
    words, first, again = np.unique(hashed, return_index=True, return_inverse=True)
    known, at = _lookup(model, 0, words)
    out = np.zeros((len(words), len(model.languages)), np.float32)
    out[known] = model.logs[0][at[known]]
    rest = np.flatnonzero(~known)
    for low in range(0, len(rest), 50_000):
        some = rest[low : low + 50_000]
        word, use, grams = gram_hashes(values, start[first[some]], end[first[some]])
        word = word[use]
        found = np.tile(model.unseen, (len(word), 1))
        open_ = np.arange(len(word))
        for order in ORDERS:
            known, at = _lookup(model, order, grams[order][use][open_])
            found[open_[known]] = model.logs[order][at[known]]
            open_ = open_[~known]
        begins = np.searchsorted(word, np.arange(len(some)))
        out[some] = np.add.reduceat(found, begins, axis=0) / np.diff(np.append(begins, len(word)))[:, None]
    return out[again]


def totals(model: Model, reader: LetterReader, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(log scores by language, number of words) of every text."""
    sums, counts, n = [], [], len(model.languages)
    for _, docs, values, doc, start, end, hashed in reader.pieces(texts):
        scores = score_words(model, values, start, end, hashed)
        counts.append(np.bincount(doc, minlength=docs))
        sums.append(np.stack([np.bincount(doc, scores[:, i], docs) for i in range(n)], axis=1))
    return (np.concatenate(sums), np.concatenate(counts)) if sums else (np.zeros((0, n)), np.zeros(0, np.int64))


def predictions(model: Model, ids: pa.Array, total: np.ndarray, count: np.ndarray) -> pa.Table:
    scaled = total / np.sqrt(np.maximum(count, 1))[:, None]
    scaled = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    best = np.argmax(scaled, axis=1)
    names = [model.languages[b] if c else UNDETERMINED for b, c in zip(best, count)]
    shares = np.where(count > 0, scaled.max(axis=1) / scaled.sum(axis=1), 0.0)
    return pa.table([ids, pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "lang_pred", "score"])


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LetterReader()
        for batch in batches:
            yield from predictions(model, batch.column(0), *totals(model, reader, batch.column(1))).to_batches()

    return run


def _score_known(model: Model):
    """(block, doc_id, n_words, sums, rest): scores of the words on the list, and the other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, n = LetterReader(), len(model.languages)
        for batch in batches:
            texts = batch.column(2)
            for first, docs, values, doc, start, end, hashed in reader.pieces(texts):
                known, at = _lookup(model, 0, hashed)
                logs = model.logs[0][at[known]] if len(model.logs[0]) else np.zeros((0, n), np.float32)
                sums = np.stack([np.bincount(doc[known], logs[:, i], docs) for i in range(n)], axis=1).astype(np.float64)
                joined = "\n".join((t.as_py() or "").lower() for t in texts.slice(first, docs))
                other = np.flatnonzero(~known)
                words = [joined[i:j] for i, j in zip(start[other].tolist(), end[other].tolist())]
                cuts = np.searchsorted(doc[other], np.arange(docs + 1)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, docs), batch.column(1).slice(first, docs),
                        pa.array(np.bincount(doc, minlength=docs).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(docs + 1) * n, pa.int32()), pa.array(sums.ravel())),
                        pa.array([" ".join(words[i:j]) for i, j in zip(cuts, cuts[1:])], pa.string()),
                    ],
                    ["block", "doc_id", "n_words", "sums", "rest"],
                )

    return run


def _block_items(model: Model):
    """(block, order, item): what the words of a block need beyond the model's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = LetterReader(), {}

        def add(block: int, order: int, items: np.ndarray) -> None:
            held.setdefault((block, order), []).append(items[~_lookup(model, order, items)[0]])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for first, n, values, doc, start, end, hashed in reader.pieces(batch.column(4)):
                own = blocks[first : first + n][doc]
                for b in np.unique(own):
                    at = np.flatnonzero(own == b)
                    words, where = np.unique(hashed[at], return_index=True)
                    add(int(b), 0, words)
                    at = at[where]
                    _, use, grams = gram_hashes(values, start[at], end[at])
                    for order, h in grams.items():
                        add(int(b), order, np.unique(h[use & (h != 0)]))
        for (b, order), parts in held.items():
            items = np.unique(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(items), b, np.int32)), pa.array(np.full(len(items), order, np.int32)), pa.array(items.view(np.int64))],
                ["block", "order", "item"],
            )

    return run


def with_items(model: Model, known: pa.Table) -> Model:
    """The model with the items of (order, item, by_lang) in its lists."""
    orders, items = known.column("order").to_numpy(), known.column("item").to_numpy().view(U64)
    by_lang = known.column("by_lang").combine_chunks().flatten().to_numpy().reshape(len(items), len(model.languages))
    hashes, logs = {}, {}
    for order in (0, *ORDERS):
        own = orders == order
        joined = np.concatenate([model.hashes[order], items[own]])
        at = np.argsort(joined)
        hashes[order] = joined[at]
        logs[order] = np.concatenate([model.logs[order], _logs(by_lang[own], model.sums[order], model.kinds[order])])[at]
    return model._replace(hashes=hashes, logs=logs)


def _predict_block(model: Model):
    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        rest, _ = totals(with_items(model, known), LetterReader(), texts.column("rest"))
        sums = texts.column("sums").combine_chunks().flatten().to_numpy().reshape(rest.shape)
        return predictions(model, texts.column("doc_id"), sums + rest, texts.column("n_words").to_numpy())

    return run


def identify_languages(docs: DataFrame, model: Model | None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", "text")
    if model is None:
        return plain.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = f"doc_id {kind}, lang_pred string, score double"
    sent = model._replace(rest=None)
    if model.rest is None:
        return plain.mapInArrow(_predict(sent), schema)
    size = plain.agg(F.coalesce(F.sum(F.octet_length(text_or_empty("text"))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    # the partition is part of the hash, so that many equal rows are not one block
    number = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks))
    block, parts = block_key(docs.sparkSession, number, int(blocks))
    scored = plain.select(block.cast("long").alias("block"), "doc_id", "text").mapInArrow(
        _score_known(sent), f"block long, doc_id {kind}, n_words long, sums array<double>, rest string"
    )
    dealt = scored.withColumn("block", F.col("block").cast("int")).repartition(parts, "block")
    # all columns pass, so that both uses of the blocks read one shuffle
    wanted = dealt.mapInArrow(_block_items(sent), "block int, order int, item long")
    known = wanted.join(model.rest, ["order", "item"]).select("block", "order", "item", "by_lang")
    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_predict_block(sent), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc32_mod("doc_id", 5) == 0
    model = fit(docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return identify_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
