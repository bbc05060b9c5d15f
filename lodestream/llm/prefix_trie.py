"""Operator 12, conversation prefix trie: chained digests of prefixes, grouped into nodes, summed over subtrees.

A turn is reduced where it is read to the SHA-256 of its role and text and its number of words; texts
don't travel. Each prefix of a conversation has a digest chained from the one before it, and equal
(depth, digest) are one node, whose conversations are its members.

Chains. Turns are numbered by a range sort and counts a partition, and chained in blocks of ``BLOCK``
turns; the ends of the blocks are chained in the same way, level by level, and every digest of a
later block is hashed with the end of the block before it. So a conversation of any length is worked
on in tasks of bounded size, and equal prefixes still get equal digests.

Subtree sums. Every node is to be exploded to all its ancestors. Nodes of one smallest member are a
chain (they are the end of its path), so they go together: one row for the chain and each of its
ancestors, which are the prefixes of that member. What a chain brings to an ancestor above it is the
same everywhere, its words and whether it ends in a leaf. So the rows are as many as the turns, not as
many as the pairs of turns of a conversation.

Scale: shuffles carry a few numbers and 16-byte digests a turn. Groups are aggregates with map-side combine;
joins on frequent nodes or long conversations are plain equi-joins, whose large partitions Spark splits. The
digest of the ids that end in a node is one running SHA-256: they pass through one task in order, in
batches, and are never held together. Everything between steps is written to the shared checkpoint folder.

Defined results for odd input: rows without conv_id belong to no conversation and are left out; a null
role or text is empty; turns go by number, null first, and equal numbers by the digest of role and text;
a repeated row is a turn of its own; very long texts are hashed and counted in the scan; an empty
table has no node, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, text_or_empty, word_count

#: Turns, or ends of blocks, that are chained in one row.
BLOCK = 256
ROOT = hashlib.sha256(b"").digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()


def digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of every turn."""
    role, text = text_or_empty("role"), text_or_empty("text")
    named = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    return conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", digest(named).alias("digest"), word_count(text).alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words): turns numbered from 0 in each conversation; no conversation is ordered in one task."""
    ordered = turns.orderBy("conv_id", F.col("turn").asc_nulls_first(), "digest")
    placed = checkpointed(ordered.select("conv_id", "digest", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    parts = placed.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # a row for each partition that a conversation reaches into
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part"))
    offsets = parts.select("conv_id", "part", (before - F.col("n") - F.col("first")).alias("offset"))
    return placed.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("offset")).alias("at"), "digest", "words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: (conv_id) of all, and their numbered turns.

    Conversation c takes its first h turns from conversation c - c % family, h being crc32(c) % most, and then goes on
    with its own turns after its first h.
    """
    turns = checkpointed(turns)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    named = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = checkpointed(named.join(of_base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    short = convs.filter("taken < h").select("conv_id", "taken")  # all others keep their numbers
    own = turns.filter(F.col("at") >= h).join(short, "conv_id", "left")
    own = own.select("conv_id", F.when(F.col("taken").isNull(), F.col("at")).otherwise(F.col("at") - h + F.col("taken")).alias("at"), "digest", "words")
    heads = turns.filter(F.col("at") < most - 1).select(F.col("conv_id").alias("base"), "at", "digest", "words")
    borrowed = convs.filter("taken > 0").join(heads, "base").filter("at < taken").select("conv_id", "at", "digest", "words")
    return convs.select("conv_id"), own.union(borrowed)


def chained(turns: DataFrame) -> DataFrame:
    """(conv_id, at, digest, parent, words, sum) of every prefix: its digest and that before it, its last words and all its words."""
    block = F.floor(F.col("at") / BLOCK).alias("block")
    listed = turns.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(F.struct("at", "digest", "words"))).alias("turns"))
    start = F.array(F.struct(F.lit(ROOT).alias("digest"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("sum")))

    def follow(so_far: Column, turn: Column) -> Column:
        last = F.element_at(so_far, -1)
        new = F.struct(digest(F.concat(last["digest"], turn["digest"])).alias("digest"), turn["words"].alias("words"), (last["sum"] + turn["words"]).alias("sum"))
        return F.concat(so_far, F.array(new))

    blocks = checkpointed(listed.select("conv_id", "block", F.aggregate("turns", start, follow).alias("chain")))
    last = F.element_at("chain", -1)
    if blocks.filter("block > 0").isEmpty():
        outer = blocks.select("*", F.lit(ROOT).alias("before"), digest(F.concat(F.lit(ROOT), last["digest"])).alias("end"), F.lit(0).cast("long").alias("sum_before"))
    else:
        ends = chained(blocks.select("conv_id", F.col("block").alias("at"), last["digest"].alias("digest"), last["sum"].alias("words")))
        above = ends.select("conv_id", F.col("at").alias("block"), F.col("parent").alias("before"), F.col("digest").alias("end"), (F.col("sum") - F.col("words")).alias("sum_before"))
        outer = blocks.join(above, ["conv_id", "block"])
    # the chain's first entry stands for what comes before the block, and a full block ends in the digest of the level above
    linked = lambda x: F.when(F.col("block") == 0, x["digest"]).otherwise(digest(F.concat("before", x["digest"])))
    whole = F.transform("chain", lambda x, i: F.when(i == 0, F.col("before")).when(i == BLOCK, F.col("end")).otherwise(linked(x)))
    rows = outer.select("conv_id", "block", "sum_before", F.posexplode(F.arrays_zip(F.slice("chain", 2, BLOCK).alias("x"), F.slice(whole, 2, BLOCK).alias("digest"), F.slice(whole, 1, F.size("chain") - 1).alias("parent"))).alias("i", "p"))
    return rows.select(
        "conv_id", (F.col("block") * BLOCK + F.col("i")).alias("at"), F.col("p.digest").alias("digest"), F.col("p.parent").alias("parent"),
        F.col("p.x.words").alias("words"), (F.col("sum_before") + F.col("p.x.sum")).alias("sum"),
    )


def _short(column: str) -> Column:
    return F.substring(column, 1, 16).alias(column)


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the ids of each node, comma-joined; rows come by node and id."""
    node, running = None, None
    for batch in batches:
        done = []
        for this, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if this != node:
                if running is not None:
                    done.append((node, running.hexdigest()))
                node, running = this, hashlib.sha256(str(conv).encode())
            else:
                running.update(b",%d" % conv)
        yield _digest_rows(done)
    if running is not None:
        yield _digest_rows([(node, running.hexdigest())])


def _digest_rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["digest", "ends_sha256"])


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the conversations (conv_id) with numbered turns (conv_id, at, digest, words).

    A node has its digest (16 bytes) and its parent's, depth, conv_id (smallest member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (of its subtree) and ends_sha256.
    """
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), zero.alias("words"), zero.alias("sum"))
    deeper = chained(turns).select("conv_id", (F.col("at") + 1).alias("depth"), "digest", "parent", "words", "sum")
    prefixes = checkpointed(roots.union(deeper).select("conv_id", "depth", _short("digest"), _short("parent"), "words", "sum"))
    groups = prefixes.groupBy("depth", "digest")
    firsts = checkpointed(groups.agg(F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), F.max(F.col("sum") - F.col("words")).alias("above")))
    children = firsts.groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children")).filter("digest IS NOT NULL")
    # the chain of a smallest member begins at its highest node
    chains = firsts.groupBy("conv_id").agg(F.min_by("above", "depth").alias("above"))
    ends = checkpointed(prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "digest", "sum")).alias("end")).select("conv_id", "end.digest", F.col("end.sum").alias("total")))
    inner = children.select("digest", F.lit(True).alias("inner"))
    brought = ends.join(chains, "conv_id", "left").join(inner, "digest", "left").select(
        "conv_id", "total",
        F.when(F.col("above").isNull(), zero).otherwise(F.col("total") - F.col("above")).alias("own"),
        (F.col("above").isNotNull() & F.col("inner").isNull()).cast("long").alias("leaf"),
    )
    sums = prefixes.join(checkpointed(brought), "conv_id").groupBy("depth", "digest").agg(
        F.min(F.struct("conv_id", "own", "total")).alias("first"),
        F.max("parent").alias("parent"),
        F.max(F.col("sum") - F.col("words")).alias("above"),
        F.count("*").alias("n_convs"),
        F.sum("leaf").alias("n_leaves"),
        F.sum("total").alias("total"),
        F.sum("own").alias("own"),
    )
    # words of all members from this depth on, less those of every node of the subtree once
    everything = F.col("total") - F.col("n_convs") * F.col("above")
    once = F.col("own") - F.col("first.own") + F.col("first.total") - F.col("above")
    nodes = sums.select("depth", "digest", "parent", F.col("first.conv_id").alias("conv_id"), "n_convs", "n_leaves", (everything - once).alias("saved_tokens"))
    above = firsts.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ended = ends.select("digest", "conv_id").repartition("digest").sortWithinPartitions("digest", "conv_id").mapInArrow(_end_digests, "digest binary, ends_sha256 string")
    return (
        nodes.join(above, "parent", "left").join(children, "digest", "left").join(ended, "digest", "left")
        .withColumn("n_children", F.coalesce("n_children", zero)).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt to begin like the first of their family."""
    trie = prefix_trie(*rebuilt(numbered(turn_rows(table(spark, sf_dir, "conversations")))))
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, g, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) - 1 AS p FROM t),
v AS (
  SELECT c, c - c % 20 AS b, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda a, s: list_reduce(list_prepend(xor(a, s), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))
    ), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT c FROM k)),
f AS (
  SELECT v.c, 0 AS part, p, g, w FROM v JOIN k ON k.c = v.b AND p < h
  UNION ALL SELECT v.c, 1, p, g, w FROM v JOIN k ON k.c = v.c AND p >= h),
l AS (SELECT c, list(g ORDER BY part, p) AS g, list(w ORDER BY part, p) AS w FROM f GROUP BY c),
a AS (SELECT v.c, coalesce(l.g, []) AS g, coalesce(l.w, []) AS w FROM v LEFT JOIN l USING (c)),
x AS (SELECT c, g, w, unnest(range(0, len(g) + 1)) AS d FROM a),
y AS (
  SELECT c, d, array_to_string(g[1:d], ',') AS key, CASE WHEN d > 0 THEN array_to_string(g[1:d - 1], ',') END AS up,
    CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, len(g) = d AS ends
  FROM x),
n AS (
  SELECT d, key, any_value(up) AS up, min(c) AS c, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM y GROUP BY d, key),
m AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
z AS (SELECT n.*, coalesce(m.n_children, 0) AS n_children FROM n LEFT JOIN m USING (d, key)),
s AS (
  SELECT y.d, y.key, sum((z.n_convs - 1) * z.w) AS saved_tokens, count(*) FILTER (WHERE z.n_children = 0) AS n_leaves
  FROM z JOIN y ON y.c = z.c AND y.d <= z.d GROUP BY y.d, y.key)
SELECT z.c AS conv_id, z.d AS depth, o.c AS parent_conv_id, z.n_convs, z.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, z.ends_sha256
FROM z JOIN s USING (d, key) LEFT JOIN n o ON o.d = z.d - 1 AND o.key = z.up
"""
