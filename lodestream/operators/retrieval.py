"""BM25 over whole texts: statistics in one pass, scores and a top-k per task in a second.

Two forms. The pool form scores ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b +
b * length / mean length)), times the query's term count capped at ``CAP``, with N, df and the mean
length of the query's pool of sources, or of all documents. The Okapi form takes ln(N - df + 0.5) -
ln(df + 0.5) over all documents, a negative one replaced by ``FLOOR`` times the mean over all terms,
and counts a repeated query term each time.

The queries are a stated set and come in blocks of ``BLOCK_QUERIES``. For each block the documents are
read twice, in Arrow batches: once to count query terms by source, once to score. No pair of query and
document is ever a row; a task gives out its k best for each query. A document is a hit if its score
is positive. Documents without text have no terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

K1, B, CAP, FLOOR = 1.5, 0.75, 3, 0.25
BLOCK_QUERIES = 500
#: Cells of the matrix of postings and queries that a task holds.
CHUNK_CELLS = 2_000_000
#: Bytes of text that are cut into words at once.
PORTION = 2_000_000

Tokeniser = Callable[[str], list[str]]


def alnum_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def blank_words(text: str) -> list[str]:
    """Lower-cased text without punctuation, cut at single blanks; empty words stay."""
    return re.sub(r"[^\w\s]", "", text.lower()).split(" ")


def portions(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``PORTION`` bytes of the text in column ``text``, so that no more is held as Python objects."""
    if batch.num_rows:
        before = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)]), dtype=np.int64)[:-1]
        cuts = [0, *(np.flatnonzero(np.diff(before // PORTION)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            yield batch.slice(low, high - low)


class _Block:
    """Some queries with their vocabulary and pools; what every task gets."""

    def __init__(self, rows: list, capped: bool, tokenise: Tokeniser) -> None:
        self.ids = [r[0] for r in rows]
        counts = [Counter(tokenise(r[1] or "")) for r in rows]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        self.wanted = [{self.vocabulary[t]: min(n, CAP) if capped else n for t, n in c.items()} for c in counts]
        pools = [None if r[2] is None else tuple(sorted(set(r[2]))) for r in rows]
        self.pools = {p: [i for i, x in enumerate(pools) if x == p] for p in dict.fromkeys(pools)}
        named = sorted({s for p in self.pools if p is not None for s in p})
        # without a query over all documents, sources that no pool names are not counted
        self.sources = {s: i for i, s in enumerate(named)}
        self.rest = len(named) if None in self.pools else None

    def source(self, name: str | None) -> int | None:
        return self.sources.get(name, self.rest)


def _blocks(queries: DataFrame, query_id: str, text: str, pool: str | None, capped: bool, tokenise: Tokeniser) -> Iterator[_Block]:
    rows, members = [], F.col(pool) if pool else F.lit(None).cast("array<string>")
    for r in queries.select(query_id, text, members.alias("__pool")).toLocalIterator():
        rows.append(tuple(r))
        if len(rows) == BLOCK_QUERIES:
            yield _Block(rows, capped, tokenise)
            rows = []
    if rows:
        yield _Block(rows, capped, tokenise)


def _term_counts(block: _Block, texts: list, tokenise: Tokeniser) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf) of the vocabulary's terms, and the length of every document."""
    at, lengths, of = [], np.zeros(len(texts), np.int64), block.vocabulary.get
    for i, text in enumerate(texts):
        words = tokenise(text) if text is not None else []
        lengths[i] = len(words)
        at += [i * len(block.vocabulary) + t for t in map(of, words) if t is not None]
    cells, tf = np.unique(np.array(at, np.int64), return_counts=True)
    doc, term = np.divmod(cells, max(1, len(block.vocabulary)))
    return doc, term, tf, lengths


def _count_terms(block: _Block, tokenise: Tokeniser):
    """(source, term, n, length): documents with a term; term -1 counts documents and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms, n_sources = len(block.vocabulary) + 1, len(block.sources) + 1
        n, length = np.zeros(n_sources * n_terms, np.int64), np.zeros(n_sources * n_terms, np.int64)
        for batch in (part for whole in batches for part in portions(whole, 0)):
            source = np.array([-1 if (s := block.source(x)) is None else s for x in batch.column(1).to_pylist()], np.int64)
            doc, term, _, lengths = _term_counts(block, batch.column(0).to_pylist(), tokenise)
            use = source[doc] >= 0
            n += np.bincount(source[doc[use]] * n_terms + term[use] + 1, minlength=len(n))
            own = source >= 0
            n += np.bincount(source[own] * n_terms, minlength=len(n))
            length += np.bincount(source[own] * n_terms, lengths[own], len(n)).astype(np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // n_terms), pa.array(at % n_terms - 1), pa.array(n[at]), pa.array(length[at])], ["source", "term", "n", "length"]
        )

    return run


def _all_terms(tokenise: Tokeniser):
    """(term, n): documents of a task with each of all terms; (null, n): all its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in (part for whole in batches for part in portions(whole, 0)):
            for text in batch.column(0).to_pylist():
                counts.update({*tokenise(text), None} if text is not None else {None})
            if len(counts) > 250_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()))], ["term", "n"])
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return run


def mean_idf(docs: DataFrame, text: str, tokenise: Tokeniser) -> float:
    """Mean of ln(N - df + 0.5) - ln(df + 0.5) over all terms of all documents."""
    df = docs.select(text).mapInArrow(_all_terms(tokenise), "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    by_df = df.groupBy(F.col("term").isNull().alias("all"), "df").agg(F.count("*").alias("terms")).collect()
    n_docs = sum(r["df"] for r in by_df if r["all"])
    terms = [(r["df"], r["terms"]) for r in by_df if not r["all"]]
    total = sum(k * (np.log(n_docs - d + 0.5) - np.log(d + 0.5)) for d, k in sorted(terms))
    return total / max(1, sum(k for _, k in terms))


class _Best:
    """The k best (score, id, row) of a task for every query; ties go to the lesser id."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k, self.held = k, [[] for _ in range(n_queries)]
        self.least = np.full(n_queries, -np.inf)

    def offer(self, query: int, scores: np.ndarray, at: np.ndarray, row_of: Callable[[int], tuple]) -> None:
        if len(scores) > self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= cut
            if keep.sum() > 4 * self.k:  # many ties: the least ids of them, all others can't be chosen
                above = np.flatnonzero(scores > cut)
                tied = sorted(np.flatnonzero(scores == cut), key=lambda i: row_of(at[i])[0])[: self.k]
                keep = np.zeros(len(scores), bool)
                keep[above] = keep[tied] = True
            scores, at = scores[keep], at[keep]
        held = self.held[query]
        held += [(-s, row_of(i)) for s, i in zip(scores.tolist(), at)]
        if len(held) > 2 * self.k:
            self.prune(query)

    def prune(self, query: int) -> list:
        self.held[query] = sorted(self.held[query], key=lambda x: (x[0], x[1][0]))[: self.k]
        if len(self.held[query]) == self.k:
            self.least[query] = -self.held[query][-1][0]
        return self.held[query]


def _score(block: _Block, weights: dict, means: dict, k: int, tokenise: Tokeniser, fields: Sequence[tuple[str, pa.DataType]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(block.ids), k)
        for batch in (part for whole in batches for part in portions(whole, 0)):
            names = batch.column(1).to_pylist()
            columns = [batch.column(i) for i in range(2, batch.num_columns)]
            # one tuple of a row for all queries that hold it
            row_of = cache(lambda i, columns=columns: tuple(c[int(i)].as_py() for c in columns))
            doc, term, tf, lengths = _term_counts(block, batch.column(0).to_pylist(), tokenise)
            for pool, queries in block.pools.items():
                if pool is None:
                    own = np.ones(len(names), bool)
                else:
                    own = np.isin(np.array([-1 if n not in block.sources else block.sources[n] for n in names]), [block.sources[s] for s in pool])
                use = own[doc]
                if not use.any():
                    continue
                d, t = doc[use], term[use]
                saturation = tf[use] * (K1 + 1) / (tf[use] + K1 * (1 - B + B * lengths[d] / means[pool]))
                starts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                step = max(1, CHUNK_CELLS // max(1, len(queries)))  # postings
                low = 0
                while low < len(starts):
                    high = max(low + 1, int(np.searchsorted(starts, starts[low] + step)))
                    high = min(high, len(starts))
                    a, b = starts[low], starts[high] if high < len(starts) else len(d)
                    scores = np.round(np.add.reduceat(weights[pool][t[a:b]] * saturation[a:b, None], starts[low:high] - a, axis=0), 6)
                    for j, q in enumerate(queries):
                        hit = np.flatnonzero((scores[:, j] > 0) & (scores[:, j] >= best.least[q]))
                        if len(hit):
                            best.offer(q, scores[hit, j], d[starts[low:high]][hit], row_of)
                    low = high
        for q, query in enumerate(block.ids):
            rows = [(query, *r, -s) for s, r in best.prune(q)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], [n for n, _ in fields])

    return run


def bm25_best(
    docs: DataFrame,
    queries: DataFrame,
    doc_id: str,
    query_id: str,
    k: int,
    carry: Sequence[str] = (),
    text: str = "text",
    source: str | None = None,
    pool: str | None = None,
    okapi: bool = False,
    tokenise: Tokeniser = alnum_words,
) -> DataFrame:
    """(query_id, doc_id, carry..., score, rank): the k best documents of every query.

    ``pool`` names a column of ``queries`` with the sources whose documents a query may find, an array
    of values of the column ``source``; null or no such column: all documents.
    """
    name = F.col(source).cast("string") if source else F.lit(None).cast("string")
    plain = docs.select(F.col(text).alias("__text"), name.alias("__source"), doc_id, *carry)
    average = mean_idf(plain, "__text", tokenise) if okapi else 0.0
    kinds = [queries.schema[query_id], *[docs.schema[c] for c in (doc_id, *carry)]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", score double"
    fields = [(f.name, to_arrow_type(f.dataType)) for f in kinds] + [("score", pa.float64())]
    found = None
    for block in _blocks(queries, query_id, text, pool, not okapi, tokenise):
        counted = plain.select("__text", "__source").mapInArrow(_count_terms(block, tokenise), "source long, term long, n long, length long")
        n = np.zeros((len(block.sources) + 1, len(block.vocabulary) + 1))
        length = np.zeros(len(block.sources) + 1)
        # at most a row for every source that a pool names and every term of the block
        for r in counted.groupBy("source", "term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect():
            n[r["source"], r["term"] + 1] = r["n"]
            length[r["source"]] += r["length"]
        weights, means = {}, {}
        for p, members in block.pools.items():
            at = slice(None) if p is None else [block.sources[s] for s in p]
            n_docs, df = n[at, 0].sum(), n[at, 1:].sum(axis=0)
            means[p] = length[at].sum() / max(1, n_docs)
            if okapi:
                idf = np.log(n_docs - df + 0.5) - np.log(df + 0.5)
                idf = np.where(idf < 0, FLOOR * average, idf)
            else:
                idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
            weights[p] = np.zeros((len(block.vocabulary), len(members)))
            for j, q in enumerate(members):
                for t, times in block.wanted[q].items():
                    weights[p][t, j] = times * idf[t]
        some = plain.mapInArrow(_score(block, weights, means, k, tokenise, fields), schema)
        found = some if found is None else found.union(some)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return top_k(found, [query_id], k, F.desc("score"), F.col(doc_id))


def top_k(scored: DataFrame, by: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order, with their rank."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def postings(docs: DataFrame, doc_id: str, tokens: Column) -> DataFrame:
    """(doc_id, term, tf, length) of all terms: the table of a saved index."""
    lengths = docs.select(doc_id, tokens.alias("__tokens")).withColumn("length", F.size("__tokens"))
    words = lengths.select(doc_id, "length", F.explode("__tokens").alias("term"))
    return words.groupBy(doc_id, "term", "length").agg(F.count("*").alias("tf"))
