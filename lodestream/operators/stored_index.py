"""A stored BM25 index: postings by shard of documents, in impact-ordered blocks that carry their best impact.

An index is a folder of three Parquet tables:

* ``blocks`` (shard, term, grp, n, held, top, docs): up to ``BLOCK`` postings (doc, tf, length) of one term, shard and group of
  documents, the n-th best, with their number and the greatest impact among them; written by shard and term, so that a few terms
  are a few pages;
* ``terms`` (term, grp, df, top) and ``totals`` (grp, n_docs, length, ...): statistics. ``totals`` is written last.

A shard is a part of a hash class, of ``SHARD_DOCS`` documents or ``SHARD_POSTINGS`` postings, whichever comes first. Texts are
dealt to tasks, and a task makes the blocks of one shard after the other by itself; no posting is a row, and no task
holds the postings of a frequent term. The impact of a posting is its term-frequency factor at
the corpus's mean length; at another mean length it grows at most by the ratio of the two.

A search of a stated set of queries reads blocks of the queries' terms and scores each shard in one task, which holds
its scores and gives out its k best of every query: no pair of query and document is a row. First a few shards
are scored as a whole; the k-th best score of a query there bounds its k-th best of all from below. Of the other shards only
blocks are read whose best posting, with the greatest contributions of all other terms of the query, reaches that bound.
A document of a block passed over stays below the bound whatever else it holds, and one that is worth its place has no
posting in such a block, so results equal those of a full scan.

Queries of one or two words pass over most blocks; for passages of fifty words, whose other terms together far
exceed the bound, few are passed over, and what is saved is reading and cutting the texts. Of an index by groups only blocks
are shuffled whose group is in the pool of a query with the term. Documents without text have no
terms but count; those without an id can't be named and are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.tables import checkpointed
from .retrieval import CAP, FLOOR, K1, B, Tokeniser, alnum_words, portions, top_k

BLOCK = 128
SHARD_DOCS = 2_500
#: Postings at which a shard is full, but for those of its last document.
SHARD_POSTINGS = 1_000_000
#: Numbers of shards that a task can give.
TASK_SHARDS = 1 << 24
#: Blocks of a batch that is written.
OUT_BLOCKS = 20_000
#: Shards that are scored whole to find the bounds.
FIRST_SHARDS = 2
#: Cells of the matrix of scores that a task holds.
CELLS = 4_000_000
#: Scores are compared after rounding to six digits; bounds give way by more.
MARGIN = 1e-5


def saturation(tf, length, mean):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _lengths(tokenise: Tokeniser):
    """(grp, n_docs, length) of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs, length = Counter(), Counter()
        for batch in batches:
            for part in portions(batch, 2):
                for grp, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    n_docs[grp] += 1
                    length[grp] += len(tokenise(text)) if text is not None else 0
            if len(n_docs) > 100_000:
                yield _totals(n_docs, length)
                n_docs.clear(), length.clear()
        yield _totals(n_docs, length)

    return run


def _totals(n_docs: Counter, length: Counter) -> pa.RecordBatch:
    columns = [pa.array(list(n_docs), pa.string()), pa.array(list(n_docs.values()), pa.int64()), pa.array([length[g] for g in n_docs], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["grp", "n_docs", "length"])


class _Shard:
    """The postings of some documents, as arrays of a document's number, a term's number and tf."""

    def __init__(self) -> None:
        self.terms: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids: list[pa.Array] = []
        self.groups: list[str | None] = []
        self.lengths: list[int] = []
        self.sizes: list[int] = []
        self.codes: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc: pa.Array, grp: str | None, words: list[str]) -> None:
        counts = Counter(words)
        self.ids.append(doc)
        self.groups.append(grp)
        self.lengths.append(len(words))
        self.sizes.append(len(counts))
        self.codes.append(np.fromiter(map(self.terms.__getitem__, counts), np.int32, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.postings += len(counts)

    def blocks(self, shard: int, mean: float, block: int) -> Iterator[pa.RecordBatch]:
        """Its blocks by term, group and impact."""
        names = sorted(self.terms)
        if not names:
            return
        place = np.empty(len(names), np.int32)
        place[[self.terms[t] for t in names]] = np.arange(len(names), dtype=np.int32)
        doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        term, tf, length = place[np.concatenate(self.codes)], np.concatenate(self.tfs), np.array(self.lengths, np.int64)
        numbers = {g: i for i, g in enumerate(dict.fromkeys(self.groups))}
        group = np.array([numbers[g] for g in self.groups], np.int32)[doc]
        impact = saturation(tf.astype(np.float64), length[doc], mean)
        order = np.lexsort((-impact, group, term))
        doc, term, tf, group, impact = doc[order], term[order], tf[order], group[order], impact[order]
        new = np.concatenate([[True], (term[1:] != term[:-1]) | (group[1:] != group[:-1])])
        lists = np.flatnonzero(new)
        nth = np.arange(len(term)) - np.repeat(lists, np.diff(np.append(lists, len(term))))
        starts = np.flatnonzero(nth % block == 0)
        ids, texts, of = pa.concat_arrays(self.ids), pa.array(names, pa.string()), pa.array(list(numbers), pa.string())
        for low in range(0, len(starts), OUT_BLOCKS):
            at = starts[low : low + OUT_BLOCKS]
            a, b = at[0], starts[low + OUT_BLOCKS] if low + OUT_BLOCKS < len(starts) else len(term)
            ends = np.append(at, b)
            held = pa.StructArray.from_arrays([ids.take(pa.array(doc[a:b])), pa.array(tf[a:b]), pa.array(length[doc[a:b]])], ["doc", "tf", "length"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), shard)), texts.take(pa.array(term[at])), of.take(pa.array(group[at])), pa.array((nth[at] // block).astype(np.int32)),
                    pa.array(np.diff(ends)), pa.array(impact[at]), pa.ListArray.from_arrays(pa.array((ends - a).astype(np.int32)), held),
                ],
                ["shard", "term", "grp", "n", "held", "top", "docs"],
            )


def _shard_blocks(tokenise: Tokeniser, mean: float, shard_docs: int, shard_postings: int, block: int):
    """The blocks of a task's documents, shard after shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() * TASK_SHARDS, _Shard()
        for batch in batches:
            for part in portions(batch, 2):
                for i, (grp, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    if len(shard.sizes) >= shard_docs or shard.postings >= shard_postings:
                        yield from shard.blocks(number, mean, block)
                        number, shard = number + 1, _Shard()
                    if text is not None:
                        shard.add(part.column(0)[i : i + 1], grp, tokenise(text))
        yield from shard.blocks(number, mean, block)

    return run


def build_index(docs: DataFrame, path: str, doc_id: str, text: str = "text", group: str | None = None, tokenise: Tokeniser = alnum_words) -> None:
    """Write the index of ``docs`` to ``path``; with ``group``, blocks and statistics are kept for each of its values."""
    kind = docs.schema[doc_id].dataType.simpleString()
    grp = F.col(group).cast("string") if group else F.lit(None).cast("string")
    plain = docs.select(F.col(doc_id).alias("doc"), grp.alias("grp"), F.col(text).alias("text")).filter("doc IS NOT NULL")
    counted = plain.mapInArrow(_lengths(tokenise), "grp string, n_docs long, length long").groupBy("grp").agg(F.sum("n_docs").alias("n_docs"), F.sum("length").alias("length"))
    totals = checkpointed(counted)
    n_docs, length = totals.agg(F.sum("n_docs"), F.sum("length")).first()
    mean = float(length or 0) / max(1, n_docs or 0) or 1.0
    # texts are dealt out once; a task makes its postings by itself, so no posting is shuffled or sorted by Spark
    dealt = plain.repartition(F.xxhash64("doc"))
    blocks = f"shard long, term string, grp string, n int, held long, top double, docs array<struct<doc:{kind},tf:int,length:long>>"
    dealt.mapInArrow(_shard_blocks(tokenise, mean, SHARD_DOCS, SHARD_POSTINGS, BLOCK), blocks).write.mode("overwrite").parquet(f"{path}/blocks")
    stored = docs.sparkSession.read.parquet(f"{path}/blocks")
    terms = stored.groupBy("term", "grp").agg(F.sum("held").alias("df"), F.max("top").alias("top"))
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    first = [r["shard"] for r in stored.select("shard").distinct().orderBy("shard").limit(FIRST_SHARDS).collect()]
    known = totals.select("*", F.lit(mean).alias("mean"), F.array(*map(F.lit, first)).cast("array<long>").alias("first"))
    known.write.mode("overwrite").parquet(f"{path}/totals")


def is_built(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(f"{path}/totals").columns)
    except AnalysisException:
        return False


def _query_terms(capped: bool, tokenise: Tokeniser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(tokenise(t or "")) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, c in enumerate(counts) for _ in c], pa.int64())
            times = [min(n, CAP) if capped else n for c in counts for n in c.values()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), pa.array([t for c in counts for t in c], pa.string()), pa.array(times, pa.int32())],
                ["query", "pool", "term", "times"],
            )

    return run


class _Plan:
    """The weighed terms of the queries, as every scoring task gets them: by term, its uses (query, weight, mean, pool)."""

    def __init__(self, rows: list) -> None:
        self.queries = sorted({r["query"] for r in rows})
        number = {q: i for i, q in enumerate(self.queries)}
        self.uses: dict[str, list] = defaultdict(list)
        for r in rows:
            self.uses[r["term"]].append((number[r["query"]], r["weight"], r["mean"], None if r["pool"] is None else frozenset(r["pool"])))


def _score_shard(held, k: int, id_type: pa.DataType, query_type: pa.DataType):
    """The k best documents of a shard for every query, from its blocks of the queries' terms."""

    def run(group: pa.Table) -> pa.Table:
        plan = held.value
        group = group.sort_by("term")
        docs = group.column("docs").combine_chunks()
        flat, ends = docs.flatten(), np.cumsum(np.concatenate([[0], docs.value_lengths().to_numpy()]))
        ids, code = np.unique(flat.field("doc").to_numpy(zero_copy_only=False), return_inverse=True)
        tf, length = flat.field("tf").to_numpy().astype(np.float64), flat.field("length").to_numpy()
        terms, groups = group.column("term").to_pylist(), group.column("grp").to_pylist()
        factors: dict = {}
        out: list[tuple] = []
        step = max(1, CELLS // max(1, len(ids)))
        for low in range(0, len(plan.queries), step):
            scores = np.zeros((min(step, len(plan.queries) - low), len(ids)))
            for i, term in enumerate(terms):
                a, b = ends[i], ends[i + 1]
                for query, weight, mean, pool in plan.uses[term]:
                    if low <= query < low + step and (pool is None or groups[i] in pool):
                        if (i, mean) not in factors:
                            factors[i, mean] = saturation(tf[a:b], length[a:b], mean)
                        scores[query - low, code[a:b]] += weight * factors[i, mean]  # a document has a term once
            for j, row in enumerate(np.round(scores, 6)):
                hit = np.flatnonzero(row > 0)
                if len(hit) > k:
                    hit = hit[row[hit] >= np.partition(row[hit], len(hit) - k)[len(hit) - k]]
                best = hit[np.lexsort((hit, -row[hit]))][:k]  # ids are sorted, so their order is that of their places
                out += [(low + j, d, s) for d, s in zip(best.tolist(), row[best].tolist())]
        queries = pa.array([plan.queries[q] for q, _, _ in out], query_type)
        return pa.table({"query": queries, "doc": pa.array(ids[[d for _, d, _ in out]].tolist(), id_type), "score": pa.array([s for *_, s in out], pa.float64())})

    return run


def _met(blocks: DataFrame, needs: DataFrame) -> DataFrame:
    """Blocks of a term and group that some query may use, with the impact it ``needs`` (pool, term, need)."""
    # one row for a term, so no block is met twice; a null group stands for all
    each = needs.select("term", F.explode_outer("pool").alias("grp"), "need").groupBy("term", "grp").agg(F.min("need").alias("need"))
    by_term = each.groupBy("term").agg(F.collect_list(F.struct("grp", "need")).alias("needs"))
    used = F.exists("needs", lambda x: (x["grp"].isNull() | (x["grp"] == F.col("grp"))) & (F.col("top") >= x["need"]))
    return blocks.join(F.broadcast(by_term), "term").filter(used).drop("needs")


class Search:
    """A search of an index: ``best`` are the results, ``blocks_read`` tells what was read for them."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, query_id: str, k: int, text: str, pool: str | None, okapi: bool, tokenise: Tokeniser) -> None:
        self.blocks, self.k = spark.read.parquet(f"{path}/blocks"), k
        terms, totals = spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/totals")
        shape = totals.select("mean", "first").first()
        mean, first_shards = (shape["mean"], shape["first"]) if shape else (1.0, [])
        self.is_first = F.col("shard").isin(first_shards)
        kind = queries.schema[query_id].dataType.simpleString()
        pools = F.col(pool) if pool else F.lit(None).cast("array<string>")
        asked = queries.select(F.col(query_id).alias("query"), F.col(text).alias("text"), pools.alias("pool"))
        worded = asked.mapInArrow(_query_terms(not okapi, tokenise), f"query {kind}, pool array<string>, term string, times int")
        inside = F.col("pool").isNull() | F.array_contains("pool", F.col("grp")) if pool else F.lit(True)
        stats = worded.join(terms, "term").filter(inside).groupBy("query", "pool", "term", "times").agg(F.sum("df").alias("df"), F.max("top").alias("top"))
        if pool:
            named = queries.select(F.col(pool).alias("p")).distinct()
            size = named.join(totals, F.col("p").isNull() | F.array_contains("p", F.col("grp"))).groupBy("p").agg(F.sum("n_docs").alias("n"), F.sum("length").alias("all"))
            known = stats.join(size, F.col("pool").eqNullSafe(F.col("p")))
        else:
            n, everything = totals.agg(F.sum("n_docs"), F.sum("length")).first()
            known = stats.withColumns({"n": F.lit(n or 0), "all": F.lit(everything or 0)})
        df, n = F.col("df"), F.col("n")
        if okapi:
            idf = F.log(n - df + 0.5) - F.log(df + 0.5)
            average = terms.groupBy("term").agg(F.sum("df").alias("df")).withColumn("n", F.lit(totals.agg(F.sum("n_docs")).first()[0] or 0)).agg(F.avg(idf)).first()[0] or 0.0
            if average < 0:
                raise ValueError("most terms are in most documents, so Okapi weights are negative and bound nothing; use bm25_best")
            idf = F.when(idf < 0, FLOOR * average).otherwise(idf)
        else:
            idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        own = F.col("all") / F.greatest(n, F.lit(1))
        weighed = known.select("query", "pool", "term", (F.col("times") * idf).alias("weight"), own.alias("mean"), F.greatest(F.lit(1.0), own / F.lit(mean)).alias("stretch"), "top")
        most = (F.col("weight") * F.col("top") * F.col("stretch")).alias("most")
        by_query = Window.partitionBy("query")  # the terms of a query
        self.plan = checkpointed(weighed.filter("weight > 0").select("*", most).withColumn("others", F.sum("most").over(by_query) - F.col("most")))
        # as many rows as the stated queries have different terms
        self.held = spark.sparkContext.broadcast(_Plan(self.plan.select("query", "term", "weight", "mean", "pool").collect()))
        id_kind = self.blocks.schema["docs"].dataType.elementType["doc"].dataType.simpleString()
        self.types = f"query {kind}, doc {id_kind}, score double"
        first = _met(self.blocks.filter(self.is_first), self.plan.select("pool", "term", F.lit(0.0).alias("need")))
        self.first = checkpointed(top_k(self._scored(first), ["query"], k, F.desc("score"), F.col("doc")).drop("rank"))
        reached = self.first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        bound = reached.filter(F.col("n") == k).select("query", (F.col("least") - MARGIN).alias("bound"))
        self.bounded = self.plan.join(F.broadcast(bound), "query", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
        # the least block impact with which a query can still reach its bound by this term
        need = ((F.col("bound") - F.col("others")) / (F.col("weight") * F.col("stretch"))).alias("need")
        self.needed = self.bounded.select("query", "pool", "term", need)
        self.read = _met(self.blocks.filter(~self.is_first), self.needed)

    def _scored(self, blocks: DataFrame) -> DataFrame:
        spark = self.blocks.sparkSession
        kinds = spark.createDataFrame([], self.types).schema
        score = _score_shard(self.held, self.k, to_arrow_type(kinds["doc"].dataType), to_arrow_type(kinds["query"].dataType))
        return blocks.select("shard", "term", "grp", "docs").groupBy("shard").applyInArrow(score, self.types)

    def best(self) -> DataFrame:
        """(query, doc, score, rank): the k best documents of every query; ties go to the lesser id."""
        return top_k(self.first.union(self._scored(self.read)), ["query"], self.k, F.desc("score"), F.col("doc"))

    def blocks_read(self) -> DataFrame:
        """(query, n_blocks, n_postings, blocks_read, postings_read): what a query's terms have, and what of it can reach the bound."""
        size = F.col("held")
        met = self.blocks.drop("docs").join(F.broadcast(self.needed), "term").filter(F.col("pool").isNull() | F.array_contains("pool", F.col("grp")))
        use = self.is_first | (F.col("top") >= F.col("need"))
        return met.groupBy("query").agg(
            F.count("*").alias("n_blocks"), F.sum(size).alias("n_postings"), F.count_if(use).alias("blocks_read"), F.sum(F.when(use, size).otherwise(0)).alias("postings_read")
        )


def search(
    spark: SparkSession, path: str, queries: DataFrame, query_id: str, k: int, text: str = "text",
    pool: str | None = None, okapi: bool = False, tokenise: Tokeniser = alnum_words,
) -> Search:
    """Search an index for the ``k`` best documents of a stated set of queries.

    ``pool`` names a column of ``queries`` with the groups whose documents a query may find, an array of values of the
    index's group; null: all. The tokeniser is that of the index.
    """
    return Search(spark, path, queries, query_id, k, text, pool, okapi, tokenise)
