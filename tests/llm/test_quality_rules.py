from collections import Counter

from helpers import docs, documents, words

from lodestream.llm import quality_rules as q


def brute(text):
    w, t = words(text), text or ""
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def check(rows, texts):
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["llr_score"] >= q.THRESHOLD)


def test_base_columns_against_brute_force(spark, sf_dir):
    rows = q.op10_quality_rules(spark, sf_dir).collect()
    pdf = documents(spark, sf_dir)
    assert len(rows) == len(pdf)
    check(rows, dict(zip(pdf.doc_id, pdf.text)))


def test_odd_rows(spark):
    long_text = "one two three four five six seven " * 3000
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, long_text), (4, long_text), (None, "a b c a b c"),
        (5, "a b \x1cc\x85d\r\ne"), (6, "a a a a"), (7, "x\n\nx\n x\nx"), (8, "# # <|>\n" * 40),
    ]
    df = docs(spark, rows).withColumn("kept", q.F.lit("clash"))
    labels = spark.createDataFrame([(4, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = q.quality_rules(df, labels).collect()
    assert len(got) == len(rows)
    check(got, dict(rows))


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = q.quality_rules(docs(spark, [(1, "word " + " ".join(map(str, range(60))))]), labels).collect()
    assert some[0]["llr_score"] == 0 and some[0]["kept"]
    assert q.quality_rules(docs(spark, []), labels).count() == 0


def test_ratios_against_brute_force(spark):
    data = docs(spark, [(1, "good fine good"), (2, "junk junk"), (3, "fine")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    ratios = q.fit_log_ratios(data, q.trusted_ids(labels), 4)
    raw, good = Counter(), Counter()
    for r in data.select("doc_id", q.F.explode(q.let(q.word_hashes(q.F.col("text")), lambda h: q.ngram_buckets(h, 4)))).collect():
        raw[r[1]] += 1
        good[r[1]] += r[0] == 1
    for b in range(4):
        share = (raw[b] + 1) / (sum(raw.values()) + 4)
        want = q.log((good[b] + 4 * share) / (sum(good.values()) + 4)) - q.log(share) if raw[b] else 0
        assert abs(ratios[b] - want) < 1e-12


def test_junk_goes_and_clean_stays(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = q.op10_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) >= 0.98 * len(clean)
    assert sum(junk) <= 0.25 * len(junk)


def test_ratio_scores_of_the_table_against_a_plain_version(spark, sf_dir):
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = {r["doc_id"] for r in marks if r["quality"] == 1 and not r["toxic"]}
    grams = {}
    for d, text in rows:
        h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words(text)]
        pairs = [xxhash.xxh64(struct.pack("<Q", b), seed=xxhash.xxh64(struct.pack("<Q", a), seed=42).intdigest()).intdigest() for a, b in zip(h, h[1:])]
        grams[d] = [signed(x) % q.BUCKETS for x in h + pairs]
    raw, trusted = Counter(), Counter()
    for d, own in grams.items():
        raw.update(own)
        if d in good:
            trusted.update(own)
    n, m = raw.total() + q.BUCKETS, trusted.total() + q.BUCKETS
    share = {b: (raw[b] + 1) / n for b in raw}
    ratio = {b: round(q.log((trusted[b] + q.BUCKETS * share[b]) / m) - q.log(share[b]), 6) for b in raw}
    for r in q.op10_quality_rules(spark, sf_dir).collect():
        own = grams[r["doc_id"]]
        want = sum(ratio[b] for b in own) / len(own) if own else 0.0
        assert abs(r["llr_score"] - want) < 1e-5
        if abs(want - q.THRESHOLD) > 1e-5:
            assert r["kept"] == (not r["base_failed"] and want >= q.THRESHOLD)
