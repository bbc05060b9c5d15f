"""Operator 5, line dedup: a log-template tree of fixed depth (native).

Every line is parsed down a tree of fixed depth: by token count, then by its ``depth`` leading
tokens, with tokens that hold a digit masked. The tokens behind them are split into halves, and one
half at a time is generalised to a variable field. So a line has two templates,
(count, lead, first half, *) and (count, lead, *, second half); lines that differ only inside one
half share one. Each half holds ``MIN_HALF`` tokens or more, so that lines never share a template for
their beginning alone; a line too short for that has one template, its count and all its masked
tokens. A template found in ``min_docs`` documents or more is recurring; of its lines only
the first, by (doc_id, position), stays, all others are dropped.

A line of fewer than ``min_tokens`` tokens has one template, its count and all its tokens as they are,
so only an equal line shares it. Blank lines always stay.

Scale: lines are reduced to two 64-bit template keys and a place, and checkpointed; texts are
shuffled once, to meet their dropped positions. A very frequent line is counted with map-side
combine, and the join that marks its occurrences is one whose large partitions Spark splits.

Defined results for odd input: a null text stays null with 0 lines; rows equal in doc_id and text
are one document and get equal results; null doc_ids are told apart by text and count as first;
an empty table gives an empty result; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, let, table, text_or_empty, word_array

DEPTH = 4
MIN_TOKENS = 5
MIN_HALF = 2
MIN_DOCS = 2


def masked_tokens(line: Column) -> Column:
    tokens = word_array(line)
    masked = let(tokens, lambda ts: F.transform(ts, lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t)))
    return F.when(line.rlike("[0-9]"), masked).otherwise(tokens)


def template_keys(tokens: Column, depth: int) -> Column:
    """The two template keys of a line's tokens, as an array of two longs."""
    n = F.size(tokens)
    half = F.ceil((n - depth) / 2).cast("int")
    lead = F.slice(tokens, 1, depth)
    first = F.when(n > depth, F.slice(tokens, F.lit(depth + 1), F.greatest(half, F.lit(0))))
    second = F.when(n > depth, F.slice(tokens, F.lit(depth + 1) + half, F.greatest(n, F.lit(0))))
    return F.array(
        F.xxhash64(F.lit("a"), n, F.array_join(lead, " "), F.array_join(first, " ")),
        F.xxhash64(F.lit("b"), n, F.array_join(lead, " "), F.array_join(second, " ")),
    )


def masked_line_key(tokens: Column) -> Column:
    """The only template key of a line without room for two halves, as an array of one long."""
    return F.array(F.xxhash64(F.lit("m"), F.size(tokens), F.array_join(tokens, " ")))


def whole_line_key(line: Column) -> Column:
    """The only template key of a short line, as an array of one long."""
    tokens = word_array(line)
    return F.array(F.xxhash64(F.lit("s"), F.size(tokens), F.array_join(tokens, " ")))


def dropped_positions(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, dropped): sorted positions of the lines to drop, for documents with any."""
    lines = docs.select(
        "doc_id",
        F.xxhash64(text_or_empty("text")).alias("text_hash"),
        F.posexplode(F.split(text_or_empty("text"), "\n")).alias("pos", "line"),
    )
    keyed = lines.select(
        "doc_id", "text_hash", "pos",
        let(
            masked_tokens(F.col("line")),
            lambda t: F.when((F.size(t) >= min_tokens) & (F.size(t) >= depth + 2 * MIN_HALF), template_keys(t, depth))
            .when(F.size(t) >= min_tokens, masked_line_key(t))
            .when(F.size(t) > 0, whole_line_key(F.col("line"))),
        ).alias("keys"),
    ).filter(F.col("keys").isNotNull())
    places = checkpointed(keyed)
    templates = places.select(F.explode("keys").alias("key"), "doc_id", "text_hash", "pos")
    by_doc = templates.groupBy("key", "doc_id", "text_hash").agg(F.min("pos").alias("pos"))
    recurring = (
        by_doc.groupBy("key")
        .agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"))
        .filter(F.col("n_docs") >= min_docs)
        .select("key", "first")
    )
    place = F.struct("doc_id", "text_hash", "pos")
    later = templates.join(recurring, "key").filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, depth: int = DEPTH, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Replace ``text`` by the text without dropped lines; add n_lines and n_dropped."""
    drops = dropped_positions(docs, depth, min_tokens, min_docs).select(
        F.col("doc_id").alias("__ls_id"), F.col("text_hash").alias("__ls_hash"), F.col("dropped").alias("__ls_dropped")
    )
    same = F.col("doc_id").eqNullSafe(F.col("__ls_id")) & (F.xxhash64(text_or_empty("text")) == F.col("__ls_hash"))
    joined = docs.drop("n_lines", "n_dropped").join(drops, same, "left")

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__ls_dropped"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    lines = F.split(F.col("text"), "\n")
    cleaned = F.when(F.col("__ls_dropped").isNull(), F.col("text")).otherwise(let(lines, without))
    return (
        joined.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
        .withColumn("n_dropped", F.when(F.col("__ls_dropped").isNull(), F.lit(0)).otherwise(F.size("__ls_dropped")).cast("long"))
        .withColumn("text", cleaned)
        .drop("__ls_id", "__ls_hash", "__ls_dropped")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines counted and a digest of its deduplicated text."""
    clean = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select(
        "doc_id", "n_lines", "n_dropped",
        F.char_length("text").cast("long").alias("clean_chars"),
        F.md5("text").alias("clean_md5"),
    )


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
v AS (SELECT doc_id, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS v FROM l),
t AS (SELECT doc_id, pos, v, list_transform(v, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS w FROM v),
h AS (SELECT *, len(w) AS n, (len(w) - 4 + 1) // 2 AS half FROM t WHERE len(w) >= 8),
k AS (
  SELECT doc_id, pos, ['a', n::VARCHAR, array_to_string(w[1:4], ' '), array_to_string(w[5:4 + half], ' ')] AS key FROM h
  UNION ALL
  SELECT doc_id, pos, ['b', n::VARCHAR, array_to_string(w[1:4], ' '), array_to_string(w[5 + half:], ' ')] AS key FROM h
  UNION ALL
  SELECT doc_id, pos, ['m', len(w)::VARCHAR, array_to_string(w, ' ')] AS key FROM t WHERE len(w) BETWEEN 5 AND 7
  UNION ALL
  SELECT doc_id, pos, ['s', len(v)::VARCHAR, array_to_string(v, ' ')] AS key FROM t WHERE len(v) BETWEEN 1 AND 4),
r AS (SELECT key, min({'d': doc_id, 'p': pos}) AS first FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
x AS (SELECT DISTINCT k.doc_id, k.pos FROM k JOIN r USING (key) WHERE k.doc_id <> r.first.d OR k.pos <> r.first.p),
c AS (
  SELECT l.doc_id, count(*) AS n_lines, count(x.pos) AS n_dropped,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE x.pos IS NULL), '') AS clean
  FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, length(clean)::BIGINT AS clean_chars, md5(clean) AS clean_md5
FROM c
"""
