"""Operator 2, LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(group | history) * P(class | group, history) * P(word | class, history).

Classes. The ``OWN_CLASSES`` most frequent words and the end of a text are classes of their own; all
other words, known or not, belong to one of the clusters of spellings. A spelling is a word's last
three bytes; spellings are clustered by the words of at most ``SHORT_BYTES`` bytes next to them, hashed
to ``BUCKETS`` buckets. The ``CLASSES`` classes are dealt into groups of ``WIDTH``.

P(group | history) and P(class | group, history) are maximum-entropy models: features of the history
are hashed to rows of weights whose sum, after a softmax over the groups or over the classes of the
group, is the distribution. Features are each of the last three words, the last two together and the
skip pair of the last and the third last. Frequent words are themselves in features, all others are
represented by their cluster.

P(word | class, history) is the word's relative frequency in its class, 0.1 added for every word and
for one unknown word. After one of the ``PAIR_HISTORIES`` most frequent words it is the frequency
after that word, smoothed by ``PAIR_PRIOR`` pseudo-counts spread like the former; in maximum-entropy
terms, a feature for every pair of a frequent word and any word, fitted in closed form under a
Dirichlet prior. Probabilities of all words and unknowns sum to one in either case.

Training is by distributed gradient updates. A weight's gradient is how often its feature and output
were observed minus how often the model expects them; both are summed over all training tokens of
all tasks. In each round a weight moves by ``RATE`` times the logarithm of the ratio of the two, with
``SMOOTH`` pseudo-counts in each. The expectation under the start weights is known from counts, so
the first update needs no pass; ``ROUNDS`` passes follow. Probabilities are summed as integers of
2^-16, so sums, weights and scores do not depend on how the texts are dealt over tasks. A task counts
equal histories first and evaluates the model once for each different one.

Scale: the class weights have a fixed size. Counts of words and pairs have not: they grow with the
vocabulary and are never collected or broadcast. Texts are dealt into blocks of about
``BLOCK_BYTES``, a block's different items are joined to their counts, and each block meets its own
small dictionary. Words are told apart by 64-bit hashes.

Defined results for odd input: a null text is empty, that is one end token; without training tokens
every base token has probability one and every class is equally likely; repeated rows are scored one
by one, and those of one input partition fall in one block; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_key, checkpointed, crc32_mod, table, text_or_empty
from .wordblocks import U64, Words, WordReader, doc_offsets, mix64

WIDTH = 16
CLASSES = WIDTH * WIDTH
OWN_CLASSES = 128
CLUSTERS = CLASSES - OWN_CLASSES - 1
END_CLASS = CLASSES - 1
OWN_SYMBOLS = 256
BEGIN = OWN_SYMBOLS + CLUSTERS
SYMBOLS = BEGIN + 1
PAIR_ROWS = 2048
#: Rows of features: last word, second last, both; then third last, skip pair.
THIRD_ROW = 2 * SYMBOLS + PAIR_ROWS
ROWS = THIRD_ROW + SYMBOLS + PAIR_ROWS
SPELLINGS = 4096
BUCKETS = 128
SHORT_BYTES = 2
ROUNDS = 2
BATCH = 4096
#: Histories whose expectations are added up at a time.
EXPECTED = 1 << 18
HELD_TOKENS = 4_000_000
SUM_CELLS = 1 << 14
RATE = 0.35
SMOOTH = 30.0
ONE = 1 << 16
ADDED = 0.1
PAIR_HISTORIES = 64
PAIR_PRIOR = 200.0
BLOCK_BYTES = 24 << 20
END_HASH = np.uint64(0x5EEDE4D0FEED0001)


class Model(NamedTuple):
    """What every executor gets; all of it of fixed size."""

    slot_shift: np.uint64  # where in a hash the 16 bits of its slot are
    slot_hash: np.ndarray  # hash of the frequent word in each slot, 0 for none
    slot_rank: np.ndarray  # its rank by frequency
    cluster: np.ndarray  # cluster of each spelling
    class_tokens: np.ndarray  # training tokens of each class
    class_words: np.ndarray  # different training words of each class
    after: np.ndarray  # PAIR_HISTORIES x CLASSES: training tokens of a class after a frequent word
    group_bias: np.ndarray  # WIDTH
    class_bias: np.ndarray  # WIDTH x WIDTH
    groups: np.ndarray  # ROWS x WIDTH: weights of the groups
    members: np.ndarray  # ROWS * WIDTH x WIDTH: weights of the classes of each group


class Tokens(NamedTuple):
    """Tokens of some documents, the end of each included."""

    doc: np.ndarray
    hash: np.ndarray
    spelling: np.ndarray
    size: np.ndarray  # in bytes, 0 for an end


def tokens_of(words: Words) -> Tokens:
    """Words and ends in order; an end has spelling -1."""
    data = words.data
    size = words.end - words.start
    tail = np.zeros(len(size), np.int64)
    for back in (1, 2, 3):
        at = np.maximum(words.end - back, words.start)
        tail = tail * 256 + np.where(size >= back, data[at], 0)
    spelling = (mix64(tail.astype(U64)) % U64(SPELLINGS)).astype(np.int64)
    at = doc_offsets(words.doc, words.n_docs)[1:]
    return Tokens(
        np.insert(words.doc, at, np.arange(words.n_docs)),
        np.insert(words.hash, at, END_HASH),
        np.insert(spelling, at, -1),
        np.insert(size, at, 0),
    )


NEIGHBOUR = -3


class Tally:
    """Counts of items of a task, merged as they come and given out before they take too much memory."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, item: np.ndarray, spelling: np.ndarray) -> None:
        unique, first, count = np.unique(item, return_index=True, return_counts=True)
        self.add_counted(unique, spelling[first], count)

    def add_counted(self, item: np.ndarray, spelling: np.ndarray, count: np.ndarray) -> None:
        self.held.append((item, spelling, count))
        self.size += len(item)

    def merged(self) -> tuple[np.ndarray, ...]:
        item, spelling, count = (np.concatenate(x) for x in zip(*self.held))
        unique, first, again = np.unique(item, return_index=True, return_inverse=True)
        return unique, spelling[first], np.bincount(again, count, len(unique)).astype(np.int64)

    def out(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.held and (last or self.size > 3_000_000):
            self.held = [self.merged()]
            self.size = len(self.held[0][0])
            if last or self.size > 1_500_000:
                item, spelling, count = self.held[0]
                self.held, self.size = [], 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item.view(np.int64)), pa.array(spelling.astype(np.int32)), pa.array(count)], ["hash", "spelling", "count"]
                )


_COUNTS = "hash long, spelling int, count long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, spelling, count): one row for each different token of a task, or of a large part of it;
    with spelling -3, rows of cells (spelling, side, bucket of the neighbour on that side)."""
    reader, tally, cells = WordReader(lower=True), Tally(), np.zeros(SPELLINGS * 2 * BUCKETS, np.int64)
    for batch in batches:
        for _, words in reader.pieces(batch.column(0)):
            t = tokens_of(words)
            tally.add(t.hash, t.spelling)
            bucket = (t.hash >> U64(40)) % U64(BUCKETS)
            for side, (a, b) in enumerate(((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1)))):
                use = (t.doc[a] == t.doc[b]) & (t.spelling[b] >= 0) & (t.size[a] > 0) & (t.size[a] <= SHORT_BYTES)
                cells += np.bincount((t.spelling[b][use] * 2 + side) * BUCKETS + bucket[a][use].astype(np.int64), minlength=len(cells))
            yield from tally.out()
    yield from tally.out(last=True)
    at = np.flatnonzero(cells)
    tally.add_counted(at.astype(U64), np.full(len(at), NEIGHBOUR), cells[at])
    yield from tally.out(last=True)


def word_slots(hashes: np.ndarray) -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """(shift, hash, rank) of a table of words in order of rank, by 16 bits in which all of them differ."""
    shifts = [U64(k) for k in range(49) if len(np.unique((hashes >> U64(k)) & U64(0xFFFF))) == len(hashes)]
    if not shifts:
        raise ValueError("no 16 bits tell the frequent words apart")
    at = (hashes >> shifts[0]) & U64(0xFFFF)
    slot_hash, slot_rank = np.zeros(1 << 16, U64), np.zeros(1 << 16, np.int64)
    slot_hash[at], slot_rank[at] = hashes, np.arange(len(hashes))
    return shifts[0], slot_hash, slot_rank


def cluster_spellings(cells: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Clusters of spellings by their neighbours: weighted spherical k-means, started from the most
    frequent spellings; spellings without a neighbour are dealt by number."""
    x = np.sqrt(cells / np.maximum(cells.sum(axis=0, keepdims=True), 1))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = x / np.maximum(norm, 1e-12)
    weight = np.log1p(tokens)[:, None] * (norm > 0)
    centres = x[np.argsort(-tokens, kind="stable")[:CLUSTERS]]
    label = np.arange(SPELLINGS) % CLUSTERS
    for _ in range(15):
        label = np.where(norm[:, 0] > 0, np.argmax(x @ centres.T, axis=1), label)
        for c in range(CLUSTERS):
            mean = (x * weight)[label == c].sum(axis=0)
            if mean.any():
                centres[c] = mean / np.sqrt((mean * mean).sum())
    return label


def symbols_and_classes(model: Model, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    slot = ((t.hash >> model.slot_shift) & U64(0xFFFF)).astype(np.uint16)
    rank = np.where(model.slot_hash[slot] == t.hash, model.slot_rank[slot], OWN_SYMBOLS)
    cluster = model.cluster[np.maximum(t.spelling, 0)]
    symbol = np.where(rank < OWN_SYMBOLS, rank, OWN_SYMBOLS + cluster)
    klass = np.where(rank < OWN_CLASSES, rank, OWN_CLASSES + cluster)
    return symbol, np.where(t.spelling < 0, END_CLASS, klass)


def histories(t: Tokens, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the last, second last and third last word of every token."""
    n = len(symbol)
    starts = np.flatnonzero(np.concatenate([[True], t.doc[1:] != t.doc[:-1]])) if n else np.zeros(0, np.int64)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    before = []
    for back in (1, 2, 3):
        s = np.full(n, BEGIN, np.int32)
        s[back:] = np.where(place[back:] >= back, symbol[: n - back], BEGIN)
        before.append(s)
    return tuple(before)


def both_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 2 * SYMBOLS + (mix64(a.astype(U64) * U64(SYMBOLS) + b.astype(U64)) % U64(PAIR_ROWS)).astype(np.int64)


def skip_row(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return THIRD_ROW + SYMBOLS + (mix64(a.astype(U64) * U64(SYMBOLS) + c.astype(U64) + U64(1 << 40)) % U64(PAIR_ROWS)).astype(np.int64)


def pair_hashes(t: Tokens, symbol: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the pairs of a frequent word and the next token, if that is of a cluster."""
    after = (t.doc[1:] == t.doc[:-1]) & (symbol[:-1] < PAIR_HISTORIES) & (t.spelling[:-1] >= 0)
    at = np.flatnonzero(after & (klass[1:] >= OWN_CLASSES) & (klass[1:] != END_CLASS)) + 1
    return at, mix64(t.hash[at] ^ mix64(symbol[at - 1].astype(U64) + U64(1 << 33)))


def _count_pairs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, tally = WordReader(lower=True), Tally()
        for batch in batches:
            for _, words in reader.pieces(batch.column(0)):
                t = tokens_of(words)
                at, pairs = pair_hashes(t, *symbols_and_classes(model, t))
                tally.add(pairs, np.full(len(pairs), -2))
                yield from tally.out()
        yield from tally.out(last=True)

    return run


def _softmax(weights: np.ndarray, bias: np.ndarray, rows: tuple[np.ndarray, ...]) -> np.ndarray:
    """Softmax of a bias plus the weights in ``rows``, for every history."""
    logits = weights.take(rows[0], axis=0, mode="clip")  # no row is out of range; this mode is the fast one
    logits += bias
    for row in rows[1:]:
        logits += weights.take(row, axis=0, mode="clip")
    # turned, so that sums over the outputs are whole-array additions, in one order for every history
    p = np.ascontiguousarray(logits.T)
    p -= p.max(axis=0)
    np.exp(p, out=p)
    total = p[0].copy()
    for x in p[1:]:
        total += x
    p /= total
    return p.T


def group_probabilities(model: Model, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _softmax(model.groups, model.group_bias, (a, SYMBOLS + b, both_row(a, b), THIRD_ROW + c, skip_row(a, c)))


def class_probabilities(model: Model, a: np.ndarray, b: np.ndarray, c: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Distributions over the classes of a group."""
    rows = (a, SYMBOLS + b, both_row(a, b), THIRD_ROW + c, skip_row(a, c))
    return _softmax(model.members, model.class_bias[group], tuple(row * WIDTH + group for row in rows))


def _scatter(sums: np.ndarray, row: np.ndarray, values: np.ndarray) -> None:
    """Add values to their rows; both are turned, outputs first. Whole numbers below 2^53 add exactly."""
    row = row.astype(np.int64)
    for total, x in zip(sums, values):
        total += np.bincount(row, x, len(total))


class Sums(NamedTuple):
    """Whole numbers for every weight."""

    groups: np.ndarray  # ROWS x WIDTH
    members: np.ndarray  # ROWS * WIDTH x WIDTH


def no_sums() -> Sums:
    return Sums(np.zeros((ROWS, WIDTH), np.int64), np.zeros((ROWS * WIDTH, WIDTH), np.int64))


def observe(a: np.ndarray, b: np.ndarray, c: np.ndarray, klass: np.ndarray, _: Model, sums: Sums) -> None:
    """Add how often features and outputs occur together."""
    for other, rows_of in ((b, lambda x, y: (x, SYMBOLS + y, both_row(x, y))), (c, lambda x, y: (THIRD_ROW + y, skip_row(x, y)))):
        key, n = np.unique((a * SYMBOLS + other) * CLASSES + klass.astype(np.int32), return_counts=True)
        pair, k = np.divmod(key, CLASSES)
        for rows in rows_of(*np.divmod(pair, SYMBOLS)):
            found = np.bincount(rows.astype(np.int64) * CLASSES + k, n, ROWS * CLASSES).astype(np.int64)
            sums.members[:] += found.reshape(sums.members.shape)
            sums.groups[:] += found.reshape(ROWS, WIDTH, WIDTH).sum(axis=2)


def expect(a: np.ndarray, b: np.ndarray, c: np.ndarray, klass: np.ndarray, model: Model, sums: Sums) -> None:
    """Add what the model expects, in units of 1 / ``ONE``; each different history is evaluated once."""
    for total, n_groups, group in ((sums.groups, 1, 0), (sums.members, WIDTH, klass // WIDTH)):
        found = np.zeros(total.shape[::-1])
        key, n = np.unique(((a * SYMBOLS + b) * n_groups + group) * SYMBOLS + c, return_counts=True)
        for low in range(0, len(key), EXPECTED):
            abg, z = np.divmod(key[low : low + EXPECTED], SYMBOLS)
            ab, g = np.divmod(abg, n_groups)
            x, y = np.divmod(ab, SYMBOLS)
            p = np.empty((WIDTH, len(z)))
            for i in range(0, len(z), BATCH):
                some = x[i : i + BATCH], y[i : i + BATCH], z[i : i + BATCH]
                each = group_probabilities(model, *some) if n_groups == 1 else class_probabilities(model, *some, g[i : i + BATCH])
                p[:, i : i + BATCH] = np.rint(each.T * np.float32(ONE))
            p *= n[low : low + EXPECTED]
            for rows in (THIRD_ROW + z, skip_row(x, z)):
                _scatter(found, rows * n_groups + g, p)
            first = np.flatnonzero(np.concatenate([[True], abg[1:] != abg[:-1]]))  # keys are in order
            p, x, y, g = np.add.reduceat(p, first, axis=1), x[first], y[first], g[first]
            for rows in (x, SYMBOLS + y, both_row(x, y)):
                _scatter(found, rows * n_groups + g, p)
        total += found.T.astype(np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers with their bytes in order of weight, which compresses well."""
    return zlib.compress(numbers.astype(np.int64).ravel().view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _sum_tokens(model: Model, add):
    """Sums of ``add`` over all training tokens of a task, in blocks of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        reader, sums, held, size = WordReader(lower=True), no_sums(), [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                add(*(np.concatenate(x) for x in zip(*held)), model, sums)
            held, size = [], 0

        for batch in batches:
            for _, words in reader.pieces(batch.column(0)):
                t = tokens_of(words)
                symbol, klass = symbols_and_classes(model, t)
                held.append((*histories(t, symbol), klass.astype(np.int16)))
                size += len(klass)
                if size > HELD_TOKENS:
                    flush()
        flush()
        both = np.concatenate([x.ravel() for x in sums])
        parts = [both[low : low + SUM_CELLS] for low in range(0, len(both), SUM_CELLS)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(parts))),
                pa.array(np.full(len(parts), TaskContext.get().partitionId())),
                pa.array([_packed(x) for x in parts], pa.binary()),
            ],
            ["block", "part", "sums"],
        )

    return run


def _add_up(group: pa.Table) -> pa.Table:
    total = sum(_unpacked(x.as_py()) for x in group.column("sums"))
    return pa.table({"block": group.column("block").slice(0, 1), "part": group.column("part").slice(0, 1), "sums": pa.array([_packed(total)], pa.binary())})


def sum_over(train: DataFrame, model: Model, add) -> Sums:
    """Sums over all training tokens."""
    schema = "block long, part long, sums binary"
    found = train.mapInArrow(_sum_tokens(model, add), schema)
    for _ in range(3):  # in steps, so that no group grows with the number of tasks
        found = found.withColumn("part", F.floor(F.col("part") / 128)).groupBy("block", "part").applyInArrow(_add_up, schema)
    empty = no_sums()
    both = np.zeros(sum(x.size for x in empty), np.int64)
    for r in found.collect():  # blocks of a fixed number of cells, one row each up to two million tasks
        part = _unpacked(r["sums"])
        both[r["block"] * SUM_CELLS : r["block"] * SUM_CELLS + len(part)] += part
    cut = empty.groups.size
    return Sums(both[:cut].reshape(empty.groups.shape), both[cut:].reshape(empty.members.shape))


def updated(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray, prior: np.ndarray, rate: float) -> np.ndarray:
    """Weights moved along the gradient's two terms, compared as logarithms."""
    step = np.log((observed + SMOOTH * prior) / (expected + SMOOTH * prior))
    return (weights + rate * step).astype(np.float32)


def count_words(train: DataFrame) -> DataFrame:
    """(hash, spelling, count) of every different token of the training texts, and of neighbour cells."""
    counted = train.select(text_or_empty("text").alias("text")).mapInArrow(_count_words, _COUNTS)
    return checkpointed(counted.groupBy("hash", "spelling").agg(F.sum("count").alias("count")))


def count_pairs(train: DataFrame, model: Model) -> DataFrame:
    """(hash, count): parts of the counts of pairs of a frequent word and a word of a cluster."""
    counted = train.select(text_or_empty("text").alias("text")).mapInArrow(_count_pairs(model), _COUNTS)
    return counted.select("hash", "count")


def fit(train: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> Model:
    """Classes and weights from (text) and the counts of all its tokens."""
    train = train.select(text_or_empty("text").alias("text"))
    common = counts.filter("spelling >= 0").orderBy(F.desc("count"), "hash").limit(OWN_SYMBOLS).collect()
    hashes = np.array([r["hash"] for r in common], np.int64).view(U64)
    cells = np.zeros(SPELLINGS * 2 * BUCKETS)
    for r in counts.filter(F.col("spelling") == NEIGHBOUR).collect():  # at most one row for each cell
        cells[r["hash"]] = r["count"]
    tokens, kinds = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    ends = 0
    for r in counts.filter(F.col("spelling") != NEIGHBOUR).groupBy("spelling").agg(F.sum("count").alias("n"), F.count("*").alias("kinds")).collect():
        if r["spelling"] < 0:
            ends = r["n"]
        else:
            tokens[r["spelling"]], kinds[r["spelling"]] = r["n"], r["kinds"]
    cluster = cluster_spellings(cells.reshape(SPELLINGS, -1), tokens)
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    class_tokens[END_CLASS] = ends
    for i, r in enumerate(common[:OWN_CLASSES]):
        class_tokens[i] = r["count"]
        tokens[r["spelling"]] -= r["count"]
        kinds[r["spelling"]] -= 1
    np.add.at(class_tokens, OWN_CLASSES + cluster, tokens)
    np.add.at(class_words, OWN_CLASSES + cluster, kinds)
    smoothed = (class_tokens + 1) / (class_tokens.sum() + CLASSES)
    of_group = smoothed.reshape(WIDTH, WIDTH).sum(axis=1)
    of_class = smoothed.reshape(WIDTH, WIDTH) / of_group[:, None]
    start = (np.zeros(x.shape, np.float32) for x in no_sums())
    biases = np.log(of_group).astype(np.float32), np.log(of_class).astype(np.float32)
    model = Model(*word_slots(hashes), cluster, class_tokens, class_words, np.zeros((PAIR_HISTORIES, CLASSES)), *biases, *start)
    seen = sum_over(train, model, observe)
    model = model._replace(after=seen.members.reshape(ROWS, CLASSES)[:PAIR_HISTORIES].astype(np.float64))
    prior = np.tile(of_class, (ROWS, 1))
    # under the start weights every history has the same distribution
    hoped = seen.groups.sum(axis=1, keepdims=True) * of_group, seen.members.sum(axis=1, keepdims=True) * prior
    for round_ in range(rounds + 1):
        if round_:
            hoped = tuple(x / ONE for x in sum_over(train, model, expect))
        model = model._replace(
            groups=updated(model.groups, seen.groups, hoped[0], of_group, RATE),
            members=updated(model.members, seen.members, hoped[1], prior, RATE),
        )
    return model


def word_log10(model: Model, t: Tokens, symbol: np.ndarray, klass: np.ndarray, count: np.ndarray, at: np.ndarray, pair_count: np.ndarray) -> np.ndarray:
    """log10 P(word | class, history) by the word's training count; ``at`` are the places of pairs."""
    single = (klass < OWN_CLASSES) | (klass == END_CLASS)
    inside = (count + ADDED) / (model.class_tokens[klass] + ADDED * (model.class_words[klass] + 1))
    seen = model.after[symbol[at - 1], klass[at]]
    inside[at] = (pair_count + PAIR_PRIOR * inside[at]) / (seen + PAIR_PRIOR)
    return np.where(single, 0.0, np.log10(inside))


def score_tokens(model: Model, t: Tokens, count_of) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, training count) of every token; ``count_of`` gives counts by hash."""
    symbol, klass = symbols_and_classes(model, t)
    at, pairs = pair_hashes(t, symbol, klass)
    count = count_of(t.hash)
    out = word_log10(model, t, symbol, klass, count, at, count_of(pairs))
    before, group = histories(t, symbol), klass // WIDTH
    for low in range(0, len(klass), BATCH):
        a, b, c = (x[low : low + BATCH] for x in before)
        g, each = group[low : low + BATCH], np.arange(len(a))
        p = group_probabilities(model, a, b, c)[each, g] * class_probabilities(model, a, b, c, g)[each, klass[low : low + BATCH] % WIDTH]
        out[low : low + BATCH] += np.log10(p)
    return out, count


class Counts:
    """Counts by hash: sorted, with the place of every prefix, so that a look-up is about one step."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts = np.append(hashes[order], U64(0)), np.append(counts[order], 0)
        self.shift = U64(64 - max(1, len(hashes).bit_length()))
        self.start = np.searchsorted(self.hashes[:-1] >> self.shift, np.arange((1 << int(U64(64) - self.shift)) + 1, dtype=U64))

    def of(self, h: np.ndarray) -> np.ndarray:
        """Counts of hashes, 0 for unknown ones."""
        prefix = (h >> self.shift).astype(np.int64)
        at, end = self.start[prefix], self.start[prefix + 1]
        found = (self.hashes[at] == h) & (at < end)
        out = np.where(found, self.counts[at], 0)
        left = np.flatnonzero(~found & (at + 1 < end))
        step = 1
        while len(left):
            here = at[left] + step
            hit = self.hashes[here] == h[left]
            out[left[hit]] = self.counts[here[hit]]
            step += 1
            left = left[~hit & (here + 1 < end[left])]
        return out


def _block_items(model: Model):
    """(block, hash): different tokens and pairs of the blocks in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader(lower=True)
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for first, words in reader.pieces(batch.column(2)):
                t = tokens_of(words)
                at, pairs = pair_hashes(t, *symbols_and_classes(model, t))
                own = blocks[first : first + words.n_docs]
                item = np.concatenate([t.hash, pairs])
                if own.min() == own.max():  # the usual case
                    held.setdefault(int(own[0]), []).append(np.unique(item))
                    continue
                of = own[np.concatenate([t.doc, t.doc[at]])]
                for b in np.unique(own):
                    held.setdefault(int(b), []).append(np.unique(item[of == b]))
        for b, parts in held.items():
            some = np.unique(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), b, np.int32)), pa.array(some.view(np.int64))], ["block", "hash"])

    return run


def _score_block(model: Model, n_tokens: int, n_words: int):
    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        reader = WordReader(lower=True)
        counts = Counts(known.column("hash").to_numpy().view(U64), known.column("count").to_numpy())
        floor = n_tokens + ADDED * (n_words + 1)
        out: dict[str, list[np.ndarray]] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for _, words in reader.pieces(texts.column("text")):
            t, n = tokens_of(words), words.n_docs
            score, count = score_tokens(model, t, counts.of)
            out["n_tokens"].append(np.bincount(t.doc, minlength=n).astype(np.int64))
            out["n_known"].append(np.bincount(t.doc, count > 0, n).astype(np.int64))
            out["base_score"].append(np.bincount(t.doc, np.log10((count + ADDED) / floor), n))
            out["score"].append(np.bincount(t.doc, score, n))
        columns = {k: pa.array(np.concatenate(v) if v else np.zeros(0)) for k, v in out.items()}
        return pa.table({"doc_id": texts.column("doc_id"), **columns})

    return run


def score_documents(docs: DataFrame, model: Model, counts: DataFrame, pairs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    words = counts.filter(F.col("spelling") != NEIGHBOUR)
    totals = words.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_or_empty("text"))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    # the partition is part of the hash, so that many equal rows are not one block
    number = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks))
    block, parts = block_key(docs.sparkSession, number, int(blocks))
    dealt = docs.select(block.alias("block"), "doc_id", text_or_empty("text").alias("text")).repartition(parts, "block")
    # all columns pass, so that both uses of the blocks read one shuffle
    wanted = dealt.mapInArrow(_block_items(model), "block int, hash long")
    # summed where it is joined, so that the parts travel once
    either = words.select("hash", "count").unionByName(pairs).groupBy("hash").agg(F.sum("count").alias("count"))
    known = wanted.join(either, "hash").select("block", "hash", "count")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    scored = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score_block(model, totals["n"], totals["v"]), schema)
    return scored.withColumn("train_tokens", F.lit(totals["n"]).cast("long"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those outside the held-out tenth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.filter(crc32_mod("doc_id", 10) != 0)
    counts = count_words(train)
    model = fit(train, counts)
    scored = score_documents(docs, model, counts, count_pairs(train, model))
    return scored.select(
        "doc_id", (crc32_mod("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
