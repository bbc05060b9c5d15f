"""Operator 13, URL filters: Bloom filter cascades that are exact on the whole corpus's keys.

A list is a set of keys; the universe is every different key that the corpus's URLs can ask for. Level
1 of a cascade is a Bloom filter of the universe's listed keys, level 2 one of the keys not listed
that level 1 lets through, level 3 one of the listed keys that level 2 lets through, and so on until
no key of the other side is left. A key is judged by the first level that doesn't let it through:
an odd one says "not listed", an even one "listed". Every key of the universe is judged rightly, and
the universe holds every key that will be asked for, so membership is exact, without a join.

Keys of a URL: every suffix of its host's labels with every prefix of its path that is as long as some
rule's path (for the host list: the host). Of the rules among them the longest decides; where none
does, the host list does. Hosts are what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
lower-cased; ports and user names are part of them.

Scale: the universe is one aggregate with map-side combine over the URLs' keys, as pairs of 64-bit
hashes (rows that share a host, however many, are one key), and is written once; lists of any size meet it
by a grouped union. A level is a count, a distributed OR of 64-bit words and a filter of what is left,
which halves from level to level. A cascade takes about 1.44 log2(others / listed) + 3 bits a listed key.
If the estimate for a list passes ``max_bytes``, its keys are dealt by hash into sections with a cascade of
their own; cascades are broadcast in groups of at most ``max_bytes``, one pass over the URLs for each,
written in between. URLs themselves are never shuffled.

Defined results for odd input: a URL that is null or has no ``://`` has an empty host and path, fits no rule
and is not listed; very long URLs cost their last labels and first letters only; repeated rows are
judged alike; empty tables and empty lists are fine; a rule given twice counts once, one that is on
both sides is allowed; columns named like an output are replaced, all others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, let, table
from .wordblocks import U64, mix64

#: Most bytes of cascades that one pass broadcasts.
MAX_BYTES = 64 << 20
#: Most keys a URL may have: labels of the longest rule host times different lengths of rule paths.
MAX_KEYS = 256
#: Share of the keys of the other side that a level after the first lets through.
LATER_PASS = 0.5
MAX_LEVELS = 64
#: Number of the host list among the lists (0 blocks, 1 allows).
HOSTS = 2

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words of a host that put it on the query's host list.
LISTED_WORDS = "spam|pills|casino|poker|lottery|porn"


class Cascade(NamedTuple):
    """Levels (bits, hashes a key, words); with no level, ``listed`` is the answer for every key."""

    levels: list[tuple[int, int, np.ndarray]]
    listed: bool = False

    def n_bytes(self) -> int:
        return sum(w.nbytes for _, _, w in self.levels)


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    at = mix64(h1 ^ U64((2 * level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = mix64(h2 + U64((level + 1) * 0xD1342543DE82EF95 % (1 << 64))) | U64(1)
    for _ in range(hashes):
        yield at % U64(bits)
        at = at + step


def passes(h1: np.ndarray, h2: np.ndarray, level: int, spec: tuple[int, int, np.ndarray]) -> np.ndarray:
    """Which keys a level lets through."""
    bits, hashes, words = spec
    through = np.ones(len(h1), bool)
    for at in _positions(h1, h2, level, bits, hashes):
        through &= (words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)
    return through


def members(h1: np.ndarray, h2: np.ndarray, cascade: Cascade) -> np.ndarray:
    """Which keys of the universe are listed."""
    out = np.full(len(h1), cascade.listed)
    left = np.arange(len(h1))
    for n, spec in enumerate(cascade.levels):
        through = passes(h1[left], h2[left], n, spec)
        out[left[~through]] = n % 2 == 1
        left = left[through]
        out[left] = n % 2 == 0  # if this level is the last
    return out


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(U64)


def _set_words(level: int, bits: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(list(_positions(_u64(batch.column(0)), _u64(batch.column(1)), level, bits, hashes)))
            at.sort()
            word = (at >> U64(6)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            ored = np.bitwise_or.reduceat(U64(1) << (at & U64(63)), first) if len(first) else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(ored.view(np.int64))], ["word", "bits"])

    return run


def _level(keys: DataFrame, n: int, level: int, rate: float) -> tuple[int, int, np.ndarray]:
    hashes = max(1, round(-np.log2(rate)))
    # with k hashes a filter of n keys lets the share (1 - exp(-kn / bits))^k through
    bits = int(-hashes * n / np.log1p(-(rate ** (1 / hashes)))) // 64 * 64 + 64
    ored = keys.select("h1", "h2").mapInArrow(_set_words(level, bits, hashes), "word long, bits long")
    packed = ored.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, U64)
    words[packed.column("word").to_numpy()] = packed.column("bits").to_numpy().view(U64)
    return bits, hashes, words


def _left_over(level: int, spec: tuple[int, int, np.ndarray], listed: bool):
    """Rows that are still open behind a level: those it encodes, and others that it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) == listed
            yield batch.filter(pa.array(own | passes(_u64(batch.column(0)), _u64(batch.column(1)), level, spec)))

    return run


def build_cascade(keys: DataFrame) -> Cascade:
    """The cascade of a universe (h1, h2, listed) of different keys."""

    def sizes(df: DataFrame) -> tuple[int, int]:
        return tuple(df.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first())

    n, others = sizes(keys)
    levels, listed = [], True
    if not n or not others:
        return Cascade([], n > 0)
    rate = min(LATER_PASS, LATER_PASS**0.5 * n / others)
    while others:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two different keys have equal hashes, so no level tells them apart")
        spec = _level(keys.filter(F.col("listed") == listed), n, len(levels), rate)
        keys = checkpointed(keys.mapInArrow(_left_over(len(levels), spec, listed), "h1 long, h2 long, listed boolean"))
        levels.append(spec)
        now = sizes(keys)
        listed, rate = not listed, LATER_PASS
        n, others = now if listed else now[::-1]
        if not n:
            break
    return Cascade(levels)


def sections(n_listed: int, n_universe: int, max_bytes: int) -> int:
    """Into how many sections a list's keys are dealt so that a cascade keeps within ``max_bytes``."""
    bits = 1.5 * n_listed * (np.log2(max(n_universe / max(n_listed, 1), 2)) + 3)
    return int(bits / 8 // max_bytes) + 1


# keys


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Every (host suffix, path prefix) that may be a rule, the longest first."""
    parts = F.split(host, r"\.")
    reach = F.array(*[F.lit(n) for n in range(1, labels + 1)])
    ends = let(parts, lambda p: F.transform(F.filter(reach, lambda n: n <= F.size(p)), lambda n: F.array_join(F.slice(p, -n, n), ".")))
    prefixes = F.array(*[F.struct(F.substring(path, 1, n).alias("path"), F.lit(n).alias("n")) for n in lengths])
    real = F.filter(prefixes, lambda x: F.char_length(x["path"]) == x["n"])
    pairs = F.flatten(F.transform(ends, lambda e: F.transform(real, lambda x: F.struct(F.char_length(F.concat(e, x["path"])).alias("n"), e.alias("host"), x["path"].alias("path")))))
    return F.reverse(F.array_sort(pairs))


def key_hashes(host: Column, path: Column) -> Column:
    """Two hashes of a key; the host can't hold a slash, so the parts stay apart."""
    return F.struct(F.xxhash64(F.lit(1), host, path).alias("h1"), F.xxhash64(F.lit(2), path, host).alias("h2"))


def universe(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """(h1, h2, listed) of every different key of ``asked``; both tables have (h1, h2). No join: a grouped union."""
    both = asked.select("h1", "h2", F.lit(True).alias("asked"), F.lit(False).alias("listed")).union(
        listed.select("h1", "h2", F.lit(False), F.lit(True))
    )
    grouped = both.groupBy("h1", "h2").agg(F.bool_or("asked").alias("asked"), F.bool_or("listed").alias("listed"))
    return grouped.filter("asked").select("h1", "h2", "listed")


def _judge(held, rules_at: int, host_at: int, marks_at: int):
    """Mark which keys of a row are on a list, for broadcast (list, section, sections of the list, cascade).

    The marks are the first place of a blocking and of an allowing rule among the keys, and whether the host is listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, host, marks = batch.column(rules_at), batch.column(host_at), batch.column(marks_at)
            flat, counts = keys.flatten(), keys.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            hashes = [(_u64(k.field(0)), _u64(k.field(1))) for k in (flat, flat, host)]
            found = [marks.field(i).to_numpy(zero_copy_only=False).copy() for i in range(3)]
            for which, section, n_sections, cascade in held.value:
                h1, h2 = hashes[which]
                mine = np.flatnonzero(h1.view(np.int64) % n_sections == section)
                hit = mine[members(h1[mine], h2[mine], cascade)]
                if which == HOSTS:
                    found[HOSTS][hit] = 1
                else:
                    np.minimum.at(found[which], row[hit], place[hit].astype(np.int32))
            new = pa.StructArray.from_arrays([pa.array(f, pa.int32()) for f in found], ["block", "allow", "listed"])
            yield pa.RecordBatch.from_arrays([new if i == marks_at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, listed_hosts: DataFrame, url: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add host, path, ``rule`` (the deciding rule's host and path, or null) and ``verdict`` (allow or block) to every row.

    ``rules`` are (host, path, verdict), ``listed_hosts`` (host); both may be of any size.
    """
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.char_length("path")).alias("lengths")).first()
    labels, lengths = shape["labels"] or 0, sorted(shape["lengths"])
    if labels * len(lengths) > MAX_KEYS:
        raise ValueError(f"rules reach {labels} labels and {len(lengths)} lengths of paths, more than {MAX_KEYS} keys a URL")
    keys = rule_keys(F.col("host"), F.col("path"), labels, lengths) if labels else F.lit(None).cast("array<struct<n:int,host:string,path:string>>")

    def keyed(df: DataFrame) -> DataFrame:
        hashed = F.coalesce(F.transform(keys, lambda k: key_hashes(k["host"], k["path"])), F.array().cast("array<struct<h1:bigint,h2:bigint>>"))
        return df.withColumn("__ls_rules", hashed).withColumn("__ls_host", key_hashes(F.col("host"), F.lit("")))

    plain = pages.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    lists = [rules.filter(F.col("verdict") == v).select(F.inline(F.array(key_hashes(F.col("host"), F.col("path"))))) for v in ("block", "allow")]
    lists.append(listed_hosts.select(F.inline(F.array(key_hashes(F.col("host"), F.lit(""))))))
    # few different (host, path prefix) stand for many rows, so keys are made once for each
    asked = keyed(plain.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path")).distinct())
    cascades = []
    for which, listed in enumerate(lists):
        column = F.col("__ls_rules") if which != HOSTS else F.array("__ls_host")
        found = checkpointed(universe(asked.select(F.inline(column)), listed))
        n, everything = found.agg(F.count_if("listed"), F.count("*")).first()
        parts = sections(n, everything, max_bytes)
        for part in range(parts if n else 0):
            cascades.append((which, part, parts, build_cascade(found.filter(F.pmod("h1", F.lit(parts)) == part))))
    none = F.lit(np.iinfo(np.int32).max)
    judged = keyed(plain).withColumn("__ls_marks", F.struct(none.alias("block"), none.alias("allow"), F.lit(0).alias("listed")))
    at = [judged.columns.index(c) for c in ("__ls_rules", "__ls_host", "__ls_marks")]
    while cascades:
        some = [cascades.pop(0)]
        while cascades and sum(c[3].n_bytes() for c in [*some, cascades[0]]) <= max_bytes:
            some.append(cascades.pop(0))
        held = pages.sparkSession.sparkContext.broadcast(some)
        judged = judged.mapInArrow(_judge(held, *at), judged.schema)
        if cascades:
            judged = checkpointed(judged)
    mark = F.col("__ls_marks")
    first = F.least(mark["block"], mark["allow"])
    rule = F.when(first < none, let(keys, lambda ks: F.concat(F.get(ks, first)["host"], F.get(ks, first)["path"])))
    by_rule = F.when(mark["allow"] <= mark["block"], "allow").otherwise("block")
    verdict = F.when(first < none, by_rule).when(mark["listed"] == 1, "block").otherwise("allow")
    return judged.withColumn("rule", rule).withColumn("verdict", verdict).drop("__ls_rules", "__ls_host", "__ls_marks")


def hosts_with_words(pages: DataFrame, pattern: str = LISTED_WORDS) -> DataFrame:
    """(host) of every different host with one of some words in it."""
    return pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host")).distinct().filter(F.col("host").rlike(pattern))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page: the longest fitting rule's, else block for listed hosts and allow for all others."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules, hosts_with_words(pages)).select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host, coalesce(rest, '') AS rest FROM p),
u AS (
  SELECT page_id, translate(coalesce(host, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(coalesce(host, '')) + 1), '^[^?#]*') AS path
  FROM s),
r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, 'spam|pills|casino|poker|lottery|porn') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
