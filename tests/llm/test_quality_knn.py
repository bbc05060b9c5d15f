import zlib

import numpy as np
from helpers import docs, documents, words

from lodestream.llm import quality_knn as q
from lodestream.llm.wordblocks import WordReader


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r["doc_id"]: r for r in q.op1_quality_knn(spark, sf).collect()}
    assert len(rows) == len(documents(spark, sf))
    for d, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    truth = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(rows[t["doc_id"]]["predicted"], t["quality"]) for t in truth if rows[t["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_votes_against_brute_force():
    rng = np.random.default_rng(2)
    vectors = q._unit(rng.standard_normal((40, 6))).astype(np.float32)
    labels = rng.integers(0, 2, 40).astype(np.float32)
    directions = np.linalg.qr(rng.standard_normal((q.TERMS, 6)))[0].astype(np.float32)
    model = q.Model(np.ones(q.TERMS, np.float32), directions, vectors, labels, 0.6)
    counts = rng.poisson(0.01, (9, q.TERMS)).astype(np.float32)
    got = q.vote(model, counts, 5)
    for i in range(9):
        x = np.log1p(counts[i])
        x = q._unit((x / np.linalg.norm(x))[None] @ directions)[0]
        cosines = vectors @ x
        near = np.argsort(-cosines)[:5]
        w = np.maximum(cosines[near], 0) ** 4
        assert abs(got[i] - ((w * labels[near]).sum() + 0.05 * 0.6) / (w.sum() + 0.05)) < 1e-5


def test_terms_count_words_and_repeats(spark):
    import pyarrow as pa

    text = "one two three\none two three\n  one  two three\nfour"
    [(_, block)] = WordReader().pieces(pa.array([text, None, ""]))
    counts = q.term_counts(block, q._character_classes())
    n = len(words(text))
    assert counts[0, : q.WORD_TERMS].sum() == n and counts[0, q.WORD_TERMS : -2].sum() == n
    assert counts[0, -1] == 2  # two lines seen before
    windows = [tuple(words(text)[i : i + 3]) for i in range(n - 2)]
    assert counts[0, -2] == len(windows) - len(set(windows))
    assert counts[1:].sum() == 0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "junk### junk###"), (4, "long " * 90000)]
    df = docs(spark, rows).withColumn("score", q.F.lit("clash"))
    labels = spark.createDataFrame([(3, 1, 0), (None, 0, 0), (1, None, None), (2, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = q.fit(q.labelled_sample(df, labels))
    got = q.classify_quality(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in q.classify_quality(df, None).collect()} == {0.5}
    assert q.fit(q.labelled_sample(df, labels.filter("false"))) is None
    assert q.classify_quality(docs(spark, []), model).count() == 0


def test_scores_of_the_table_against_a_plain_version(spark, sf_dir):
    import pyarrow as pa

    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = q.fit(q.labelled_sample(docs_, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    text = {r["doc_id"]: r["text"] for r in docs_.collect()}
    reader, classes = WordReader(), q._character_classes()
    for r in q.op1_quality_knn(spark, sf_dir).collect():
        [(_, block)] = reader.pieces(pa.array([text[r["doc_id"]]]))
        x = np.log1p(q.term_counts(block, classes)[0].astype(float)) * model.idf
        x = x / max(np.linalg.norm(x), 1e-9) @ model.directions
        cosines = model.vectors @ (x / max(np.linalg.norm(x), 1e-9))
        near = sorted(range(len(cosines)), key=lambda i: -cosines[i])[: q.NEIGHBOURS]
        weight = [max(cosines[i], 0) ** 4 for i in near]
        want = (sum(w * model.labels[i] for w, i in zip(weight, near)) + q.PRIOR_WEIGHT * model.prior) / (sum(weight) + q.PRIOR_WEIGHT)
        assert abs(r["score"] - want) < 1e-4


def test_ties_share_the_last_place():
    model = q.Model(np.ones(q.TERMS, np.float32), np.eye(q.TERMS, 2, dtype=np.float32), np.array([[1, 0], [0.6, 0.8], [0.6, 0.8], [0.6, 0.8]], np.float32), np.array([1, 0, 1, 1], np.float32), 0.5)
    counts = np.zeros((1, q.TERMS), np.float32)
    counts[0, 0] = 3
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]):
        turned = model._replace(vectors=model.vectors[order], labels=model.labels[order])
        want = (1 + 0.6**4 * 2 / 3 + 0.05 * 0.5) / (1 + 0.6**4 + 0.05)
        assert abs(q.vote(turned, counts, 2)[0] - want) < 1e-6


def test_clashing_labels_and_the_layout(spark, sf_dir):
    df = docs(spark, [(1, "a b"), (1, "c d"), (2, "e f")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, None)], "doc_id long, quality int")
    got = sorted((r["text"], r["label"]) for r in q.labelled_sample(df, labels).collect())
    assert got == [("a b", 0.0), ("c d", 0.0), ("e f", 1.0)]
    assert q.labelled_sample(df, labels, 2).count() == 2
    docs_, marks = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    found = []
    for parts in (1, 8):
        dealt = docs_.repartition(parts)
        model = q.fit(q.labelled_sample(dealt, marks))
        found.append({r["doc_id"]: r["score"] for r in q.classify_quality(dealt, model).collect()})
    assert all(abs(found[1][d] - x) < 1e-9 for d, x in found[0].items())


def test_scores_do_not_depend_on_the_rows_of_a_block():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.02, (812, q.TERMS)).astype(np.float32)
    labelled, idf = counts[:300], np.ones(q.TERMS, np.float32)
    directions = q._grid(np.linalg.qr(rng.standard_normal((q.TERMS, 64)))[0])
    vectors = q._grid(q._unit(q._grid(q._weighted(labelled, idf)) @ directions))
    model = q.Model(idf, directions, vectors, (rng.random(300) < 0.5).astype(np.float32), 0.5)
    whole = q.vote(model, counts[300:])
    for rows in (1, 7, 100, 511):
        cut = np.concatenate([q.vote(model, counts[a : a + rows]) for a in range(300, 812, rows)])
        assert abs(cut - whole).max() < 1e-12
