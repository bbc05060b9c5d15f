"""Operator 4, near-duplicate documents: DartMinHash signatures, banded joining, exact check.

Signature (Christiani, 2020). A text is a weighted set: its five-word shingles, weighted by how
often they occur. Every element's weight axis is cut into the regions [0, 1), [1, 2), [2, 4), ...
and the rank axis likewise. A hash of (element, weight region, rank region) says how many darts
land there (a Poisson number), and where; a dart is a hit if it lies below the element's weight.
Each dart has a coordinate; the hit of lowest rank is the signature's value there. Darts are thrown
to the rank at which about k log k of them are hits, so a signature costs a pass over the elements
plus k log k, not elements times k, and two signatures agree at a coordinate with probability equal
to the weighted Jaccard similarity.

Joining. ``bands`` groups of ``rows`` coordinates are hashed to bucket keys. Texts sharing a bucket
are compared exactly on their shingle multisets and linked at ``threshold`` (0.8) or more. With 36
bands of 7 rows a pair at 0.8 is missed with probability 0.0002, one at 0.85 with 3e-6.

Comparing. Every text belongs to one tile: texts with the same largest bucket, dealt by hash into
tiles of about ``TILE_TEXTS`` texts and ``TILE_ITEMS`` shingles. Groups of bounded size are compared as a
whole, by exact counts of common shingles, so no pair is ever a row; of the links found in a group
a spanning forest is written, at most one link for each text. First every tile is compared with
itself, and in a bucket of several tiles all other texts with one of them. The connected components so far join
nearly all texts of a family. A pair that shares a bucket and has neither been compared nor joined lies in
different components of the bucket, so one of its texts is outside the bucket's largest component:
these texts are then compared with all tiles of the bucket that they haven't met. So no link
between two components is lost. Classes are the connected components of all links.

A class's id is its least doc_id; ids are only labels, classes are told apart by their component, so
null or repeated doc_ids never join texts that are not similar. The row that stays is the one with
the class's least doc_id (nulls last), of several such the one with the least text hash.

Scale: signatures are computed where the text is read, once for each different text of a task, and
only keys travel. Texts are shuffled once, one copy of each; what meets in groups is shingles of
texts that share a bucket. A family of n different near copies costs about 2n / tile groups and as
many comparisons of s outsiders with a tile; only where a bucket falls apart into components of like size, texts
alike at less than the threshold, does the number of groups grow with its square. Everything is
checkpointed to the shared folder between steps.

Defined results for odd input: null and blank texts have no shingle; equal texts are one class,
null being its own text; a text of one to four words is one shingle; null doc_ids never become a
class id unless the class has no other; of rows equal in doc_id and text one stays; an empty table
gives an empty result; columns named like an output are replaced. Texts are told apart by 64-bit
hashes: among 10^9 different texts a clash is expected 0.03 times, among 10^11 about 270 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .components import connected_components
from .wordblocks import U64, WordReader, doc_offsets, mix64, uniform, window_hashes

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 36
ROWS = 7
TILE_TEXTS = 1024
TILE_ITEMS = 1_000_000
#: Groups that a text is sent to in one row.
SENT_TO = 1024
#: Texts of a task that it remembers, so as not to sign a copy again.
REMEMBERED = 200_000


def _poisson_cdf(mean: float) -> np.ndarray:
    top = int(mean + 12 * mean**0.5 + 24)
    terms = np.empty(top + 1)
    terms[0] = np.exp(-mean)
    for i in range(1, top + 1):
        terms[i] = terms[i - 1] * mean / i
    return np.cumsum(terms)


def weighted_sets(doc: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, weight) of every different element of a document, sorted by both."""
    order = np.lexsort((element, doc))
    d, e = doc[order], element[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (e[1:] != e[:-1])
    at = np.flatnonzero(new)
    return d[at], e[at], np.diff(np.append(at, len(d))).astype(np.float64)


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures, uint64 of shape (n_docs, k); rows of documents without elements are all zero."""
    total = np.bincount(doc, weight, n_docs)
    limit = np.zeros(n_docs)
    limit[total > 0] = k * (np.log(k) + 4) / total[total > 0]
    rank = np.full(n_docs * k, np.inf)
    value = np.zeros(n_docs * k, U64)
    # weight regions an element reaches into: 0 is [0, 1), r is [2^(r-1), 2^r)
    cells, at = [], np.arange(len(doc))
    region = 0
    while len(at):
        cells.append((at, region))
        low_next = 2.0**region
        at = at[weight[at] > low_next]
        region += 1
    todo = limit > 0
    done_to = np.zeros(n_docs)
    while todo.any():
        rank_region, rank_low = 0, 0.0
        while rank_low < limit[todo].max():
            rank_high = 2.0**rank_region
            for at, region in cells:
                d = doc[at]
                use = todo[d] & (limit[d] > rank_low) & (done_to[d] < rank_high)
                if not use.any():
                    continue
                a = at[use]
                low, width = (0.0, 1.0) if region == 0 else (2.0 ** (region - 1), 2.0 ** (region - 1))
                seed = mix64(element[a] ^ U64(0x632BE59BD9B4E019 * (region * 64 + rank_region + 1) % (1 << 64)))
                cdf = _poisson_cdf(width * (rank_high - rank_low))
                n = np.searchsorted(cdf, uniform(seed), "right")
                owner = np.repeat(np.arange(len(a)), n)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                dart = mix64(seed[owner] + (number + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
                r = rank_low + (rank_high - rank_low) * uniform(mix64(dart ^ U64(0xA0761D6478BD642F)))
                where = doc[a][owner]
                hit = r < limit[where]
                if region:
                    hit &= low + width * uniform(mix64(dart ^ U64(0xE7037ED1A0B428DB))) < weight[a][owner]
                owner, dart, r, where = owner[hit], dart[hit], r[hit], where[hit]
                slot = where * k + (mix64(dart ^ U64(0x8EBC6AF09C88C6E3)) % U64(k)).astype(np.int64)
                np.minimum.at(rank, slot, r)
                best = r == rank[slot]
                value[slot[best]] = dart[best]
            rank_low, rank_region = rank_high, rank_region + 1
        empty = np.isinf(rank).reshape(n_docs, k).any(axis=1)
        todo &= empty
        # a text with an empty coordinate is thrown at again, to twice the rank
        rank.reshape(n_docs, k)[todo] = np.inf
        limit[todo] *= 2
    return value.reshape(n_docs, k)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), U64)
    grouped = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    for r in range(rows):
        keys = mix64((keys ^ grouped[:, :, r]) + U64(0x9E3779B97F4A7C15))
    return mix64(keys ^ np.arange(1, bands + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _sign(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = WordReader(), set()
        for batch in batches:
            fresh = []
            for i, tid in enumerate(batch.column(0).to_pylist()):
                if tid not in seen:
                    seen.add(tid)
                    fresh.append(i)
            if len(seen) > REMEMBERED:
                seen.clear()
            batch = batch.take(pa.array(fresh, pa.int64()))
            tids = batch.column(0)
            for first, words in reader.pieces(batch.column(1)):
                doc, shingle = window_hashes(words, width)
                sets = weighted_sets(doc, shingle)
                some = np.unique(sets[0])
                renumber = np.zeros(words.n_docs, np.int64)
                renumber[some] = np.arange(len(some))
                keys = band_keys(dart_minhash(renumber[sets[0]], sets[1], sets[2], len(some), bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(some) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel())
                )
                n_items = pa.array(np.bincount(doc, minlength=words.n_docs)[some])
                yield pa.RecordBatch.from_arrays([tids.take(pa.array(first + some)), n_items, lists], ["tid", "n_items", "keys"])

    return run


def _items(width: int):
    """Shingle multisets as arrays, a row for every group that the text belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader()
        for batch in batches:
            tids, groups = batch.column(0), batch.column(2)
            for first, words in reader.pieces(batch.column(1)):
                doc, element, weight = weighted_sets(*window_hashes(words, width))
                # the n-th occurrence of a shingle is an element of its own
                n = weight.astype(np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                copy = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                items = mix64(element[owner] + copy.astype(U64) * U64(0xD1342543DE82EF95))
                ends = doc_offsets(doc[owner], words.n_docs)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(items.view(np.int64)))
                own = groups.slice(first, words.n_docs)
                at = np.repeat(np.arange(words.n_docs), own.value_lengths().to_numpy())
                places = own.flatten()
                for low in range(0, len(at), 1024):
                    some = pa.array(at[low : low + 1024])
                    yield pa.RecordBatch.from_arrays(
                        [
                            places.field("group").slice(low, len(some)), places.field("side").slice(low, len(some)),
                            tids.slice(first, words.n_docs).take(some), lists.take(some),
                        ],
                        ["group", "side", "tid", "items"],
                    )

    return run


def common_items(owner: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """How many items each two of n owners share, as a matrix; an owner has an item once."""
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    new = np.ones(len(item), bool)
    new[1:] = item[1:] != item[:-1]
    at = np.flatnonzero(new)
    df = np.diff(np.append(at, len(item)))
    shared, most = np.zeros(n * n, np.float32), max(16, n // 16)
    # items of few owners: pairs of neighbours at each distance in their lists
    few = np.repeat((df > 1) & (df <= most), df)
    o, size, place = owner[few], np.repeat(df, df)[few], (np.arange(len(item)) - np.repeat(at, df))[few]
    held, n_held = [], 0
    for step in range(1, most):
        left = np.flatnonzero(place + step < size)
        if not len(left):
            break
        held.append(o[left] * n + o[left + step])
        n_held += len(left)
        if n_held > 4_000_000:
            shared += np.bincount(np.concatenate(held), minlength=n * n)
            held, n_held = [], 0
    if held:
        shared += np.bincount(np.concatenate(held), minlength=n * n)
    shared = shared.reshape(n, n)
    shared += shared.T
    # items of many owners: a matrix product, some columns at a time
    many = df > most
    column = np.repeat(np.where(many, np.cumsum(many) - 1, -1), df)
    o, column = owner[column >= 0], column[column >= 0]
    for low in range(0, int(many.sum()), 2048):
        a, b = np.searchsorted(column, [low, low + 2048])
        x = np.zeros((n, 2048), np.float32)
        x[o[a:b], column[a:b] - low] = 1
        shared += x @ x.T
    return shared


def forest(near: np.ndarray) -> np.ndarray:
    """The least member of the component of each node of a symmetric boolean matrix."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
        least = np.minimum(least, least[least])
        if np.array_equal(least, label):
            return label
        label = least


def _link(threshold: float):
    """Links (u, v) of a group: a spanning forest of its pairs at the threshold or above."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("tid")
        tids, sides = group.column("tid").to_numpy(), group.column("side").to_numpy()
        lists = group.column("items").combine_chunks()
        size, n = lists.value_lengths().to_numpy().astype(np.int64), len(tids)
        shared = common_items(np.repeat(np.arange(n), size), lists.flatten().to_numpy(), n).astype(np.float64)
        near = shared / (size[:, None] + size[None, :] - shared) >= threshold
        np.fill_diagonal(near, False)
        if sides.max() > 0:  # two tiles: pairs inside one are another group's
            near &= sides[:, None] != sides[None, :]
        root = forest(near)
        linked = root != np.arange(n)
        return pa.table({"u": pa.array(tids[linked]), "v": pa.array(tids[root[linked]])})

    return run


def _tiles(members: DataFrame) -> DataFrame:
    """(tid, tile): every text of a shared bucket by its largest bucket, in parts of bounded size."""
    home = members.groupBy("tid").agg(F.max(F.struct("n", "key"))["key"].alias("home"), F.first("n_items").alias("n_items"))
    sizes = home.groupBy("home").agg(F.count("*").alias("texts"), F.sum("n_items").alias("items"))
    parts = F.greatest(F.ceil(F.col("texts") / TILE_TEXTS), F.ceil(F.col("items") / TILE_ITEMS))
    part = F.pmod(F.xxhash64("tid", F.lit(1)), F.col("parts"))
    return home.join(sizes.select("home", parts.alias("parts")), "home").select("tid", F.xxhash64("home", part).alias("tile"))


def _sent(rows: DataFrame, owner: str) -> DataFrame:
    """(owner, groups): lists of (group, side) of about ``SENT_TO`` at most; an owner in more groups has several rows."""
    cuts = rows.groupBy(owner).count().filter(F.col("count") > SENT_TO).select(owner, F.ceil(F.col("count") / SENT_TO).alias("cuts"))
    cut = F.coalesce(F.pmod("group", F.col("cuts")), F.lit(0)).alias("cut")
    return rows.join(cuts, owner, "left").groupBy(owner, cut).agg(F.collect_list(F.struct("group", "side")).alias("groups")).drop("cut")


def _links(texts: DataFrame, wanted: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links (u, v) found by comparing the groups of ``wanted`` (tid, groups)."""
    items = texts.join(wanted, "tid").select("tid", "text", "groups").mapInArrow(_items(width), "group long, side int, tid long, items array<long>")
    return checkpointed(items.groupBy("group").applyInArrow(_link(threshold), "u long, v long").filter("u <> v"))


def _against(asked: DataFrame, tiles: DataFrame, name: str) -> DataFrame:
    """(tid, groups): groups that compare each text of ``asked`` (tid, tile) with the whole tile, ``TILE_TEXTS`` texts at a time."""
    sizes = asked.groupBy("tile").agg(F.ceil(F.count("*") / TILE_TEXTS).alias("cuts"))
    cut = F.pmod(F.xxhash64("tid", F.lit(2)), F.col("cuts"))
    dealt = asked.join(sizes, "tile").select("tid", F.xxhash64(F.lit(name), "tile", cut).alias("group"), F.lit(0).alias("side"))
    whole = sizes.select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"))
    whole = whole.select("tile", F.xxhash64(F.lit(name), "tile", "cut").alias("group"), F.lit(1).alias("side"))
    return _sent(dealt, "tid").union(tiles.join(_sent(whole, "tile"), "tile").select("tid", "groups"))


def near_components(texts: DataFrame, threshold: float, bands: int, rows: int, width: int) -> DataFrame:
    """(tid, component) of all texts of (tid, text) with a link to a different text."""
    schema = "tid long, n_items long, keys array<long>"
    signed = checkpointed(texts.mapInArrow(_sign(bands, rows, width), schema).dropDuplicates(["tid"]))
    placed = signed.select(F.explode("keys").alias("key"), "tid", "n_items")
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = checkpointed(placed.join(shared, "key"))
    tiles = checkpointed(_tiles(members))
    once = texts.groupBy("tid").agg(F.first("text").alias("text"))
    alone = tiles.join(tiles.groupBy("tile").count().filter("count > 1").select("tile"), "tile")
    wanted = alone.select("tid", F.array(F.struct(F.xxhash64(F.lit("alone"), "tile").alias("group"), F.lit(0).alias("side"))).alias("groups"))
    # a bucket in one tile, the usual case, asks for that tile with itself only
    met = members.select("key", "tid").join(tiles, "tid").select("key", "tile").distinct()
    several = met.groupBy("key").count().filter("count > 1").select("key")
    wide = checkpointed(met.join(several, "key"))
    # the same few tiles, those in most buckets, lead many buckets
    ranked = wide.join(wide.groupBy("tile").agg(F.count("*").alias("buckets")), "tile")
    leads = ranked.groupBy("key").agg(F.max(F.struct("buckets", "tile"))["tile"].alias("lead"))
    own = members.select("key", "tid").join(leads, "key").join(tiles, "tid")
    led = checkpointed(own.filter("tile <> lead").select("tid", F.col("lead").alias("tile")).distinct())
    links = _links(once, wanted.union(_against(led, tiles, "lead")), threshold, width)
    found = checkpointed(connected_components(links)).withColumnRenamed("node", "tid")
    if wide.isEmpty():
        return found
    named = members.join(leads.select("key"), "key").select("key", "tid").join(found, "tid", "left")
    named = checkpointed(named.select("key", "tid", F.coalesce("component", "tid").alias("component")))
    parts = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component"))["component"].alias("largest")).filter("parts > 1")
    outside = named.join(largest, "key").filter("component <> largest").select("key", "tid")
    asked = outside.join(wide, "key").select("tid", "tile").distinct()
    # neither its own tile nor one that it has been compared with
    asked = checkpointed(asked.join(tiles.union(led), ["tid", "tile"], "left_anti"))
    if asked.isEmpty():
        return found
    more = _links(once, _against(asked, tiles, "open"), threshold, width)
    joined = more.union(found.select(F.col("tid").alias("u"), F.col("component").alias("v")))
    return checkpointed(connected_components(joined)).withColumnRenamed("node", "tid")


def near_classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    width: int = SHINGLE_WORDS,
) -> DataFrame:
    """The class of every different text: (tid, component, class_id, class_size, best_tid).

    ``tid`` is xxhash64(text), ``component`` tells classes apart, and the row of the class that
    stays has doc_id ``class_id`` and text ``best_tid``.
    """
    tid = F.xxhash64("text")
    texts = docs.select(tid.alias("tid"), "text").filter(F.col("text").isNotNull())
    component = near_components(texts, threshold, bands, rows, width)
    copies = docs.groupBy(tid.alias("tid")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    owned = checkpointed(copies.join(component, "tid", "left").withColumn("component", F.coalesce("component", "tid")))
    best = F.min(F.struct(F.col("first_id").isNull(), "first_id", "tid"))
    classes = owned.groupBy("component").agg(best.alias("best"), F.sum("copies").alias("class_size"))
    return owned.select("tid", "component").join(classes, "component").select(
        "tid", "component", F.col("best.first_id").alias("class_id"), "class_size", F.col("best.tid").alias("best_tid")
    )


def label_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """Add class_id and class_size to every row of ``docs``."""
    classes = near_classes(docs, **parameters).select(F.col("tid").alias("__ls_tid"), "class_id", "class_size")
    rows = docs.drop("class_id", "class_size").withColumn("__ls_text", F.xxhash64("text"))
    return rows.join(classes, F.col("__ls_text") == F.col("__ls_tid")).drop("__ls_text", "__ls_tid")


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """Keep one row of each class, one with its least doc_id, with all its columns."""
    classes = near_classes(docs.select("doc_id", "text"), **parameters).filter("tid = best_tid")
    best = classes.select("tid", F.col("class_id").alias("best_id"))
    rows = docs.select(F.xxhash64("text").alias("tid"), F.struct("*").alias("row"))
    same_id = F.col("row.doc_id").eqNullSafe(F.col("best_id"))
    stay = rows.join(best, (rows["tid"] == best["tid"]) & same_id).select(best["tid"], "row")
    if not stay.groupBy("tid").count().filter("count > 1").isEmpty():  # rows equal in doc_id and text
        stay = stay.groupBy("tid").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return stay.select("row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document; one row of each class is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = near_classes(docs)
    # numbered once and written, so that rows equal in doc_id and text are told apart
    rows = checkpointed(docs.select("doc_id", F.xxhash64("text").alias("tid"), F.monotonically_increasing_id().alias("row")))
    labelled = rows.join(classes, "tid")
    best = (F.col("tid") == F.col("best_tid")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    # joined by row numbers, which are all different, so a large class is no hot key
    first = labelled.filter(best).groupBy("component").agg(F.min("row").alias("first_row")).select("first_row")
    marked = labelled.join(first, F.col("row") == F.col("first_row"), "left")
    return marked.select("doc_id", "class_id", "class_size", F.col("first_row").isNotNull().alias("kept"))
