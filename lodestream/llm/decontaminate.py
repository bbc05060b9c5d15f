"""Operator 8, benchmark decontamination: pigeonhole edit matching.

A text contains a test item if some stretch of it is within the item's error budget, ``rate`` of
its length in edits. An item with budget e is split into e + 1 pieces; e edits can't touch all of
them, so every match holds at least one piece exactly. One automaton finds all pieces of all items
in a pass over a text; where a piece is found, Myers' bit-parallel algorithm verifies the text
around it. The same argument holds for halves: of n pieces with at most n - 1 edits, one half of n'
pieces has at most n' - 1. So some piece found exactly has, at every level of a binary tree over the
pieces, a surrounding run of n' pieces within n' - 1 edits, and a hit is checked from the smallest
run upwards, which ends chance hits early. No match is missed and none is wrong.

Texts and items are lower-cased and runs of blanks count as one space.

Scale: a pass over the documents without a shuffle. The items are the stated query set; they are
sent to the executors in blocks of at most ``BLOCK_CHARS`` characters, one pass over the documents
for each block, written before the next begins, so what a task holds is bounded.

Defined results for odd input: null and blank texts match nothing, as documents and as items; items
of fewer than ``MIN_CHARS`` characters after normalisation have no error budget and match as whole
words only; a repeated or null item id is one item per row; repeated document rows are matched one by one; empty tables give no match; documents keep
whatever other columns they have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpointed, table

ERROR_RATE = 0.1
MIN_CHARS = 24
BLOCK_CHARS = 8_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def split_pieces(item: str, rate: float) -> tuple[int, list[tuple[int, str]]]:
    """(error budget e, e + 1 pieces with their offsets in the item); a short item is one piece."""
    budget = int(len(item) * rate) if len(item) >= MIN_CHARS else 0
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item prepared for Myers' algorithm: one integer of position bits per character."""

    def __init__(self, item: str) -> None:
        self.size = len(item)
        self.mask = (1 << self.size) - 1
        self.bits: dict[str, int] = {}
        for i, c in enumerate(item):
            self.bits[c] = self.bits.get(c, 0) | (1 << i)

    def search(self, text: str, budget: int) -> tuple[int, int] | None:
        """(least distance, end) of a stretch of ``text`` within ``budget`` of the item."""
        bits, mask, top = self.bits, self.mask, 1 << (self.size - 1)
        plus, minus, distance = mask, 0, self.size
        best, left = None, len(text)
        for end, c in enumerate(text, 1):
            eq = bits.get(c, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (~(horizontal | plus) & mask)
            down = plus & horizontal
            if up & top:
                distance += 1
            elif down & top:
                distance -= 1
            up = (up << 1) & mask
            down = (down << 1) & mask
            plus = down | (~(vertical | up) & mask)
            minus = up & vertical
            if distance <= budget and (best is None or distance < best[0]):
                best = (distance, end)
            left -= 1
            if distance - left > budget and best is None:
                return None  # it can't fall fast enough any more
        return best


def climbs(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces the runs of pieces around it, smallest first, without the whole."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    level = [(0, n)]
    while level:
        halves = [h for a, b in level if b - a > 1 for h in ((a, (a + b) // 2), ((a + b) // 2, b))]
        for a, b in halves:
            if b - a > 1:
                for i in range(a, b):
                    out[i].insert(0, (a, b))
        level = halves
    return out


class Matcher:
    """Finds the items of a block in texts; built once per task."""

    def __init__(self, items: list[str], rate: float) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.items, self.cuts, self.climbs, self.patterns, found = items, [], [], {}, {}
        for number, item in enumerate(items):
            budget, pieces = split_pieces(item, rate)
            self.cuts.append([offset for offset, _ in pieces] + [len(item)])
            self.climbs.append(climbs(budget + 1))
            for i, (_, piece) in enumerate(pieces):
                found.setdefault(piece, []).append((number, i))
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def whole_words(self, text: str, number: int, begin: int) -> bool:
        """Neither end of an item found at ``begin`` lies inside a word."""
        end = begin + len(self.items[number])
        return not (begin and text[begin - 1].isalnum() and text[begin].isalnum()) and not (
            end < len(text) and text[end].isalnum() and text[end - 1].isalnum()
        )

    def near(self, text: str, number: int, a: int, b: int, low: int, high: int) -> tuple[int, int] | None:
        """Best (distance, end) of pieces a to b of an item, if begun between low and high."""
        pattern = self.patterns.get((number, a, b))
        if pattern is None:
            cuts = self.cuts[number]
            pattern = self.patterns[number, a, b] = Pattern(self.items[number][cuts[a] : cuts[b]])
        budget = b - a - 1
        begin = max(0, low - budget)
        hit = pattern.search(text[begin : max(0, high + pattern.size + budget)], budget)
        return hit and (hit[0], begin + hit[1])

    def match(self, text: str) -> dict[int, tuple[int, int]]:
        """Best (distance, end in the normalised text) of every item that the text contains."""
        if self.empty or not text:
            return {}
        begins: dict[int, set[int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for number, i in places:
                cuts = self.cuts[number]
                begin = last + 1 - size - cuts[i]
                if begin in begins.get(number, ()):
                    continue
                if len(self.items[number]) < MIN_CHARS and not self.whole_words(text, number, begin):
                    continue
                for a, b in self.climbs[number][i]:
                    if not self.near(text, number, a, b, begin + cuts[a], begin + cuts[a]):
                        break
                else:
                    begins.setdefault(number, set()).add(begin)
        out = {}
        for number, starts in begins.items():
            pieces = len(self.cuts[number]) - 1
            hits = [self.near(text, number, 0, pieces, low, high) for low, high in _runs(sorted(starts), pieces)]
            best = min((h for h in hits if h), default=None)
            if best:
                out[number] = best
        return out


def _runs(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """First and last of each run of starts that lie at most ``gap`` apart."""
    first = last = starts[0]
    for s in starts[1:]:
        if s - last > gap:
            yield first, last
            first = s
        last = s
    yield first, last


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """Blocks of (ids, normalised texts), of at most ``BLOCK_CHARS`` characters or one item each."""
    ids, texts, chars = [], [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        item = normalise(row[1])
        if not item:
            continue
        if texts and chars + len(item) > BLOCK_CHARS:
            yield ids, texts
            ids, texts, chars = [], [], 0
        ids.append(row[0])
        texts.append(item)
        chars += len(item)
    if texts:
        yield ids, texts


def find_matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, match_end): the items that each document contains."""
    plain = docs.select("doc_id", "text")
    schema = f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, distance int, match_end long"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    parts = []
    for ids, texts in item_blocks(benchmark, "item_id", "text"):

        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(texts, rate)
            for batch in batches:
                rows = []
                for i, value in enumerate(batch.column(1)):
                    for number, (distance, end) in matcher.match(normalise(value.as_py())).items():
                        rows.append((i, ids[number], distance, end))
                at, item, distance, end = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array(item, item_type),
                        pa.array(distance, pa.int32()),
                        pa.array(end, pa.int64()),
                    ],
                    ["doc_id", "item_id", "distance", "match_end"],
                )

        parts.append(plain.mapInArrow(run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    if len(parts) == 1:
        return parts[0]
    out = checkpointed(parts[0])
    for part in parts[1:]:
        out = out.union(checkpointed(part))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    at, schema = docs.columns.index("text"), docs.schema
    waiting = False
    for _, texts in item_blocks(benchmark, "item_id", "text"):
        if waiting:  # one block's automaton at a time in a task
            docs = checkpointed(docs)

        def run(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(texts, rate)
            for batch in batches:
                clean = [not matcher.match(normalise(v.as_py())) for v in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs, waiting = docs.mapInArrow(run, schema), True
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair that matches, with the edit distance."""
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", F.col("distance").cast("int").alias("distance"), "match_end"
    )
