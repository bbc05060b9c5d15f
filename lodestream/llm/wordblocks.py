"""Words of Arrow string batches as numpy arrays, without Python strings.

A batch's bytes are cut into words and hashed in bulk: the hash of a word is a polynomial in its
bytes modulo 2^64, read off a running sum, then mixed. Words are equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; bounds the working memory of a task whatever the text lengths.
PIECE_BYTES = 2 << 20
_HASH_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


class Words(NamedTuple):
    """Words of some documents in order: document number, byte range in ``data``, hash."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    n_docs: int


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; input and output are uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


class _Powers:
    """Powers of the base and of its inverse, grown as needed and kept for the task."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, U64(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


class WordReader:
    """Cuts and hashes words; one per task."""

    def __init__(self, lower: bool = False) -> None:
        self.powers = _Powers()
        values = np.arange(256)
        self.lower = np.where((values >= 65) & (values <= 90), values + 32, values).astype(np.uint8) if lower else None
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self.table = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))

    def pieces(self, texts: pa.Array) -> Iterator[tuple[int, Words]]:
        """(number of the first document, words) of consecutive groups of documents."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and len(body) else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
            last = min(max(last, first + 1), len(texts))
            yield first, self.words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        if self.lower is not None:
            data = self.lower[data]
        n = len(data)
        inside = ~self.blank[data]
        opens, closes = inside.copy(), inside.copy()
        if n:
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edges = offsets[(offsets > 0) & (offsets < n)]
            opens[edges] = inside[edges]
            closes[edges - 1] = inside[edges - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        doc = np.searchsorted(offsets, start, "right") - 1
        return Words(data, doc, start, end, self._hash(data, start, end), len(offsets) - 1)

    def _hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), U64)
        i = 0
        while i < len(start):
            j = max(int(np.searchsorted(start, start[i] + _HASH_BYTES)), i + 1)
            at, stop = start[i], end[j - 1]
            up, down = self.powers.get(int(stop - at))
            sums = np.zeros(stop - at + 1, U64)
            np.cumsum(self.table[data[at:stop]] * up[: stop - at], out=sums[1:])
            s, e = start[i:j] - at, end[i:j] - at
            out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0x8CB92BA72F3D8DD7))
            i = j
        return out


def doc_offsets(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Where each document's words begin, and the end of the last."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def window_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all windows of ``width`` words; a shorter document is one window."""
    offsets = doc_offsets(words.doc, words.n_docs)
    length = np.diff(offsets)
    h = words.hash
    n = max(len(h) - width + 1, 0)
    full = np.zeros(n, U64)
    for k in range(width):
        full = (full ^ h[k : k + n]) * U64(0x9FB21C651E98DF25)
        full ^= full >> U64(29)
    whole = words.doc[:n] == words.doc[width - 1 : width - 1 + n] if n else np.zeros(0, bool)
    doc, hashed = words.doc[:n][whole], mix64(full[whole])
    short = np.flatnonzero((length > 0) & (length < width))
    if len(short):
        tails = []
        for d in short:
            x = U64(length[d])
            with np.errstate(over="ignore"):
                for v in h[offsets[d] : offsets[d + 1]]:
                    x = (x ^ v) * U64(0xA24BAED4963EE407)
                    x ^= x >> U64(32)
            tails.append(x)
        doc, hashed = np.concatenate([doc, short]), np.concatenate([hashed, mix64(np.array(tails, U64))])
        order = np.argsort(doc, kind="stable")
        doc, hashed = doc[order], hashed[order]
    return doc, hashed
