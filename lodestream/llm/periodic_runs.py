"""Operator 11, periodic runs of words: Kolpakov and Kucherov's algorithm, and texts collapsed to one period.

A run is a stretch of words with smallest period q, at least ``min_length`` and 2q words long, that
no neighbouring word extends. All runs of a text are found in time linear in its words:

1. A suffix automaton with first end positions gives the Lempel-Ziv factors of the text, each with
   an earlier occurrence.
2. Main's algorithm finds, by four prefix tables around every factor boundary, the runs that touch
   the boundary. A run whose last word lies in factor u(j) reaches back less than 2|u(j-1)| + |u(j)|
   words from the boundary before it (otherwise u(j-1) would be longer), which bounds the tables.
3. Every other run lies strictly inside a factor and is copied from its earlier occurrence.

Words that can't lie in a run are passed over first: with h = ceil(min_length / 2), the two halves of
a run agree on at least h consecutive words, so every word of a run is covered by an h-word window
that occurs twice in the text. Windows are hashed and sorted for a whole batch of texts at once; the
algorithm reads each stretch of covered words. Words are equal if their 64-bit hashes are.

A word is dropped from the collapsed text if some run holds it after the run's first q words.

Scale: one pass where the texts are read, no shuffle. Working memory is about 1 kB for each word of the
longest covered stretch; a text is never cut, so a very long text needs memory in proportion to it.

Defined results for odd input: null and blank texts have no words and no runs, and an empty collapsed
text; repeated rows and ties don't matter, every row stands alone; an empty table gives an empty
result; columns named like an output are replaced, all others are carried along. In the query a null
doc_id means that the text is read as it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import let, table, text_or_empty, word_array
from .wordblocks import U64, WordReader, doc_offsets, mix64

MIN_LENGTH = 12
ADDED = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (begin, end, earlier begin) of s; a first letter has -1 as its earlier begin.

    The suffix automaton keeps for every state where its strings first end; a factor is read along
    it as long as that lies before the factor's own end.
    """
    link, length, first, step = [-1], [0], [-1], [{}]
    last = 0
    for i, c in enumerate(s):
        new = len(length)
        length.append(i + 1)
        first.append(i)
        step.append({})
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                first.append(first[q])
                step.append(dict(step[q]))
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    found, i, n = [], 0, len(s)
    while i < n:
        state, at = 0, i
        while at < n:
            follow = step[state][s[at]]
            if first[follow] >= at:
                break
            state, at = follow, at + 1
        found.append((i, at, first[state] - (at - i) + 1) if at > i else (i, i + 1, -1))
        i = max(at, i + 1)
    return found


def prefix_table(s: list[int]) -> list[int]:
    """For every place of s, how many letters from there on agree with its beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    low = high = 0
    for i in range(1, n):
        k = min(z[i - low], high - i) if i < high else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > high:
            low, high = i, i + k
        z[i] = k
    return z


def runs_at_boundary(s: list[int], left: int, mid: int, right: int, min_length: int) -> Iterator[tuple[int, int, int]]:
    """Runs (begin, end, period) of s that touch ``mid`` and lie in [left, right), by Main's algorithm."""
    x, y = s[left:mid], s[mid:right]
    n_x, n_y = len(x), len(y)
    ahead = prefix_table([*y, -1, *x, *y])
    x.reverse()
    y.reverse()
    back = prefix_table([*x, -1, *y, *x])
    found = []
    for p in range(1, n_y + 1):  # a whole period lies behind the boundary
        after, before = (ahead[p] if p < n_y else 0), back[n_x + 1 + n_y - p]
        if after + before >= p and after + before + p >= min_length:
            found.append((mid - before, mid + p + after, p))
    for p in range(1, n_x + 1):  # a whole period lies before it
        after, before = min(ahead[n_y + 1 + n_x - p], n_y), (back[p] if p < n_x else 0)
        if after + before >= p and after + before + p >= min_length:
            found.append((mid - p - before, mid + after, p))
    for begin, end, p in found:
        whole_left = begin > left or begin == 0 or s[begin - 1] != s[begin - 1 + p]
        whole_right = end < right or end == len(s) or s[end] != s[end - p]
        if whole_left and whole_right:
            yield begin, end, p


def runs_of(s: list[int], min_length: int) -> list[tuple[int, int, int]]:
    """All runs (begin, end, smallest period) of a sequence of numbers from 0 on, by begin and end."""
    parts = factors(s)
    found: dict[tuple[int, int], int] = {}
    size_before = 0
    for begin, end, _ in [*parts, (len(s), len(s), -1)]:
        left = max(0, begin - 2 * size_before - (end - begin))
        if end - left >= min_length:
            for b, e, p in runs_at_boundary(s, left, begin, end, min_length):
                found[b, e] = min(p, found.get((b, e), p))
        size_before = end - begin
    by_begin: dict[int, list[tuple[int, int]]] = {}
    for (b, e), p in found.items():
        by_begin.setdefault(b, []).append((e, p))
    for begin, end, earlier in parts:
        if earlier >= 0 and end - begin >= min_length + 2:
            shift, stop = begin - earlier, earlier + end - begin
            for b in range(earlier + 1, stop - min_length):
                if b in by_begin:
                    inside = [(e + shift, p) for e, p in by_begin[b] if e < stop]
                    if inside:
                        by_begin.setdefault(b + shift, []).extend(inside)
    return sorted((b, e, p) for b, ends in by_begin.items() for e, p in ends)


def covered_stretches(hashes: np.ndarray, doc: np.ndarray, width: int, least: int) -> list[tuple[int, int]]:
    """(begin, end) of the longest stretches, of ``least`` words or more, of words in ``width``-word windows that their text has twice."""
    n = len(hashes) - width + 1
    if n <= 1:
        return []
    mixed = mix64(doc[:n].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))
    for k in range(width):
        mixed = (mixed ^ hashes[k : k + n]) * U64(0x9FB21C651E98DF25)
        mixed ^= mixed >> U64(29)
    places = np.flatnonzero(doc[:n] == doc[width - 1 :])
    mixed = mixed[places]
    order = np.argsort(mixed)
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(places), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int64)
    at = places[twice]
    change[at] += 1
    change[at + width] -= 1  # windows begin at different places, so no index is repeated
    covered = np.cumsum(change[:-1]) > 0
    opens, closes = covered.copy(), covered.copy()
    border = doc[1:] != doc[:-1]
    opens[1:] &= ~covered[:-1] | border
    closes[:-1] &= ~covered[1:] | border
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist()))


def _collapse(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    words = text.split()  # at the six blanks of the word rule
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for begin, end, period in runs:
            change[begin + period] += 1
            change[end] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def _detect(text_at: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader()
        for batch in batches:
            texts = batch.column(text_at).cast(pa.string())
            for low, words in reader.pieces(texts):
                offsets = doc_offsets(words.doc, words.n_docs)
                runs: dict[int, list[tuple[int, int, int]]] = {}
                for begin, end in covered_stretches(words.hash, words.doc, -(-min_length // 2), min_length):
                    numbers = np.unique(words.hash[begin:end], return_inverse=True)[1].tolist()
                    d = int(words.doc[begin])
                    shift = begin - int(offsets[d])
                    runs.setdefault(d, []).extend((b + shift, e + shift, p) for b, e, p in runs_of(numbers, min_length))
                listed = [
                    [{"start": b, "length": e - b, "period": p} for b, e, p in sorted(runs.get(d, ()), key=lambda r: (r[0], r[2]))]
                    for d in range(words.n_docs)
                ]
                rows = batch.slice(low, words.n_docs)
                raw = texts.slice(low, words.n_docs).cast(pa.binary()).to_pylist()
                clean = [_collapse(t or b"", runs.get(d, [])) for d, t in enumerate(raw)]
                added = [pa.array(np.diff(offsets), pa.int64()), pa.array(listed, _RUNS), pa.array(clean, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*batch.schema.names, "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """Add n_words, ``runs`` (an array of start, length, period by start, then period) and the ``collapsed`` text to every row."""
    if min_length < 2:
        raise ValueError("a run has at least two words")
    rows = docs.drop("n_words", "runs", "collapsed")
    schema = StructType([*rows.schema, *StructType.fromDDL(ADDED)])
    return rows.mapInArrow(_detect(rows.columns.index(text), min_length), schema)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text, by a hash of its doc_id, repeats itself with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def periodic(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        behind = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), behind), " ")

    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when((h % 10 == 0) & worded, let(word_array(text_or_empty("text")), periodic)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, the longest of them, and digests of all runs and of the collapsed text."""
    found = find_runs(planted(table(spark, sf_dir, "documents")))
    # the longest run; ties go to the smallest start, then period
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = found.withColumn("top", F.array_min(order))
    return longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.n")).alias("length"),
        F.col("top.period").alias("period"),
        F.floor(-F.col("top.n") * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
