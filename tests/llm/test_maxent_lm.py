import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, documents

from lodestream.llm import maxent_lm as lm
from lodestream.llm.wordblocks import WordReader

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + ["\n"]


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    return lm.op2_lm_score(spark, sf).collect(), documents(spark, sf)


def test_base_against_brute_force(scored):
    rows, pdf = scored
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in pdf.doc_id}
    counts = Counter()
    for d, t in zip(pdf.doc_id, pdf.text):
        if not held[d]:
            counts.update(tokens(t))
    n, v = counts.total(), len(counts)
    text = dict(zip(pdf.doc_id, pdf.text))
    assert len(rows) == len(text)
    for r in rows:
        own = tokens(text[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(own), n)
        assert r["n_known"] == sum(counts[t] > 0 for t in own)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)


def test_held_out_texts_are_likelier_than_by_the_base(scored):
    rows, _ = scored
    held = [r for r in rows if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] - r["base_score"] for r in held) / n > 0.2


def plain_score(model, counts, pairs, text):
    """log10 probability of a text, token by token, from the model's numbers."""
    [(_, words)] = WordReader(lower=True).pieces(pa.array([text]))
    t = lm.tokens_of(words)
    symbol, klass = lm.symbols_and_classes(model, t)
    own = tokens(text)
    assert len(own) == len(symbol)
    total = 0.0
    for i, k in enumerate(klass):
        before = [symbol[i - back] if i >= back else lm.BEGIN for back in (1, 2, 3)]
        a, b, c = (np.array([x]) for x in before)
        both, skip = lm.both_row(a, b)[0], lm.skip_row(a, c)[0]
        rows = [before[0], lm.SYMBOLS + before[1], both, lm.THIRD_ROW + before[2], skip]
        g, j = divmod(int(k), lm.WIDTH)
        of_group = model.groups[rows].astype(float).sum(axis=0) + model.group_bias
        of_class = model.members.reshape(lm.ROWS, lm.WIDTH, -1)[rows, g].astype(float).sum(axis=0) + model.class_bias[g]
        for logits, at in ((of_group, g), (of_class, j)):
            total += logits[at] - np.log(np.exp(logits).sum())
        if lm.OWN_CLASSES <= k < lm.END_CLASS:
            inside = (counts[own[i]] + 0.1) / (model.class_tokens[k] + 0.1 * (model.class_words[k] + 1))
            if i and symbol[i - 1] < lm.PAIR_HISTORIES:
                inside = (pairs[own[i - 1], own[i]] + lm.PAIR_PRIOR * inside) / (model.after[symbol[i - 1], k] + lm.PAIR_PRIOR)
            total += math.log(inside)
    return total / math.log(10)


def plain_counts(texts):
    counts, pairs = Counter(), Counter()
    for text in texts:
        own = tokens(text)
        counts.update(own)
        pairs.update(zip(own, own[1:]))
    return counts, pairs


def test_scores_of_the_table_against_a_plain_version(spark, sf_dir):
    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    train = docs_.filter(lm.crc32_mod("doc_id", 10) != 0)
    counts = lm.count_words(train)
    model = lm.fit(train, counts)
    plain = plain_counts(r["text"] for r in train.collect())
    text = {r["doc_id"]: r["text"] for r in docs_.collect()}
    got = lm.op2_lm_score(spark, sf_dir).collect()
    assert len(got) == len(text)
    for r in got:
        assert math.isclose(r["score"], plain_score(model, *plain, text[r["doc_id"]]), rel_tol=1e-5)


def test_scores_do_not_depend_on_the_layout(spark, sf_dir):
    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = []
    for parts in (1, 8):
        dealt = docs_.repartition(parts)
        train = dealt.filter(lm.crc32_mod("doc_id", 10) != 0)
        counts = lm.count_words(train)
        model = lm.fit(train, counts)
        scored = lm.score_documents(dealt, model, counts, lm.count_pairs(train, model), block_bytes=20_000 * parts)
        found.append({r["doc_id"]: (r["base_score"], r["score"]) for r in scored.collect()})
    assert found[0].keys() == found[1].keys()
    for d, pair in found[0].items():
        assert np.allclose(pair, found[1][d], rtol=1e-9, atol=0)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "the cat sat", "the dog sat on the mat", "b c a", ""] * 30 + [" ".join(f"w{i} r{i * 7 % 211}" for i in range(400))]
    train = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(2)
    counts = lm.count_words(train)
    model = lm.fit(train, counts)
    [(_, words)] = WordReader(lower=True).pieces(pa.array(["the cat sat on unknownword", "a B zzz"]))
    t = lm.tokens_of(words)
    symbol, klass = lm.symbols_and_classes(model, t)
    a, b, c = lm.histories(t, symbol)
    assert np.allclose(lm.group_probabilities(model, a, b, c).sum(axis=1), 1, atol=1e-5)
    for g in range(lm.WIDTH):
        assert np.allclose(lm.class_probabilities(model, a, b, c, np.full(len(a), g)).sum(axis=1), 1, atol=1e-5)
    # words of a class and its unknown word, after nothing in particular and after a frequent word
    plain, pairs = plain_counts(texts)
    all_words = counts.filter("spelling >= 0").collect()
    own = {int(h) for h, r in zip(model.slot_hash, model.slot_rank) if h and r < lm.OWN_CLASSES}
    rest = [r for r in all_words if int(np.int64(r["hash"]).view(np.uint64)) not in own]
    classes = {lm.OWN_CLASSES + model.cluster[r["spelling"]] for r in rest}
    assert rest and classes
    for k in classes:
        mass = sum(r["count"] + 0.1 for r in rest if lm.OWN_CLASSES + model.cluster[r["spelling"]] == k) + 0.1
        assert math.isclose(mass, model.class_tokens[k] + 0.1 * (model.class_words[k] + 1))
    [(_, words)] = WordReader(lower=True).pieces(pa.array([" ".join(w for w in plain if w != "\n")]))
    t = lm.tokens_of(words)
    klass = dict(zip([w for w in plain if w != "\n"], lm.symbols_and_classes(model, t)[1]))
    rank = {w: r for w, r in zip([w for w in plain if w != "\n"], lm.symbols_and_classes(model, t)[0])}
    for word, r in rank.items():
        if r < lm.PAIR_HISTORIES:
            for k in classes:
                assert sum(n for (x, y), n in pairs.items() if x == word and y != "\n" and klass[y] == k) == model.after[r, k]


def test_a_round_of_updates_lowers_the_loss():
    rng = np.random.default_rng(0)
    a, b, c = rng.integers(0, lm.SYMBOLS, (3, 4000)).astype(np.int32)
    a[:2000] %= 9
    b[:2000] %= 3
    klass = ((a * 5 + c % 2) % lm.CLASSES).astype(np.int16)
    flat = np.full(lm.WIDTH, 1 / lm.WIDTH)
    biases = np.log(flat).astype(np.float32), np.log(np.tile(flat, (lm.WIDTH, 1))).astype(np.float32)
    model = lm.Model(*[np.zeros(0)] * 7, *biases, *(x.astype(np.float32) for x in lm.no_sums()))
    seen = lm.no_sums()
    lm.observe(a, b, c, klass, model, seen)
    rows = {"a": a, "b": lm.SYMBOLS + b, "ab": lm.both_row(a, b), "c": lm.THIRD_ROW + c, "ac": lm.skip_row(a, c)}
    group, each = (klass // lm.WIDTH).astype(int), np.arange(4000)
    for name, r in rows.items():
        for row in np.unique(r)[:40]:
            assert np.array_equal(seen.groups[row], np.bincount(group[r == row], minlength=lm.WIDTH))
            if row < lm.ROWS:
                want = np.bincount(klass[r == row], minlength=lm.CLASSES)
                assert np.array_equal(seen.members.reshape(lm.ROWS, -1)[row], want)
    loss = []
    for _ in range(6):
        g, j = lm.group_probabilities(model, a, b, c), lm.class_probabilities(model, a, b, c, group)
        loss.append(-np.log(g[each, group] * j[each, klass % lm.WIDTH]).mean())
        hope = lm.no_sums()
        lm.expect(a, b, c, klass, model, hope)
        whole = lambda p: np.rint(p * np.float32(lm.ONE)).astype(int)
        for name, r in rows.items():  # against sums token by token
            for row in np.unique(r)[:40]:
                assert np.array_equal(hope.groups[row], whole(g)[r == row].sum(axis=0))
                if row < lm.ROWS:
                    at = (r == row) & (group == 1)
                    assert np.array_equal(hope.members[row * lm.WIDTH + 1], whole(j)[at].sum(axis=0))
        model = model._replace(
            groups=lm.updated(model.groups, seen.groups, hope.groups / lm.ONE, flat, lm.RATE),
            members=lm.updated(model.members, seen.members, hope.members / lm.ONE, flat, lm.RATE),
        )
    assert all(y < x for x, y in zip(loss, loss[1:])) and loss[-1] < 0.6 * loss[0]


def test_look_up_of_counts():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    hashes[:40] = np.uint64(7 << 60) + np.arange(40, dtype=np.uint64)  # one crowded prefix
    hashes = np.unique(np.append(hashes, np.uint64((1 << 64) - 1)))
    counts = lm.Counts(hashes, np.arange(1, len(hashes) + 1))
    assert np.array_equal(counts.of(hashes), np.arange(1, len(hashes) + 1))
    assert not counts.of(np.setdiff1d(hashes + np.uint64(1), hashes)).any()
    assert lm.Counts(hashes[:0], np.zeros(0, int)).of(hashes).sum() == 0


def test_every_block_gets_a_partition(spark):
    for blocks in (1, 5, 40):
        key, parts = lm.block_key(spark, lm.F.col("id"), blocks)
        dealt = spark.range(blocks).select(key.alias("k")).repartition(parts, "k").select(lm.F.spark_partition_id().alias("p"), "k")
        rows = dealt.collect()
        assert parts == blocks and len({r["k"] for r in rows}) == len({r["p"] for r in rows}) == blocks


def test_sums_survive_packing():
    numbers = np.random.default_rng(3).integers(0, 1 << 40, 1000)
    assert np.array_equal(lm._unpacked(lm._packed(numbers)), numbers)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Some words\there"), (3, "Some words\there"), (None, "x"), (4, "long word " * 50000)]
    df = docs(spark, rows).withColumn("score", lm.F.lit("clash"))
    counts = lm.count_words(df)
    model = lm.fit(df, counts)
    pairs = lm.count_pairs(df, model)
    got = sorted(((r["doc_id"] or -1, r["n_tokens"], r["n_known"]) for r in lm.score_documents(df, model, counts, pairs).collect()))
    assert got == [(-1, 2, 2), (1, 1, 1), (2, 1, 1), (3, 4, 4), (3, 4, 4), (4, 100001, 100001)]
    nothing = df.filter("false")
    none = lm.count_words(nothing)
    model = lm.fit(nothing, none)
    untrained = lm.score_documents(df, model, none, lm.count_pairs(nothing, model)).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == 0 and r["score"] < 0 for r in untrained)
    assert lm.score_documents(docs(spark, []), model, counts, pairs).count() == 0


def test_every_history_word_has_a_feature_of_its_own():
    t = lm.Tokens(np.array([0, 0, 0, 0, 1, 1, 1]), np.zeros(7, np.uint64), *np.zeros((2, 7), np.int64))
    last, second, third = lm.histories(t, np.array([7, 1, 2, 3, 4, 5, 6]))
    assert third.tolist() == [lm.BEGIN] * 3 + [7] + [lm.BEGIN] * 3
    assert (last.tolist(), second.tolist()) == ([lm.BEGIN, 7, 1, 2, lm.BEGIN, 4, 5], [lm.BEGIN, lm.BEGIN, 7, 1, lm.BEGIN, lm.BEGIN, 4])


def test_default_fit_trains_two_rounds_over_whole_classes(spark, monkeypatch):
    passes, once = [], lm.sum_over
    monkeypatch.setattr(lm, "sum_over", lambda train, model, add: passes.append(add) or once(train, model, add))
    train = spark.createDataFrame([("the cat sat on the mat",)] * 20, "text string").coalesce(1)
    lm.fit(train, lm.count_words(train))
    assert passes == [lm.observe, lm.expect, lm.expect]
    assert lm.CLASSES >= 128 and lm.OWN_SYMBOLS >= 256
