import random

from helpers import docs, documents

from lodestream.llm import decontaminate as dc


def least_distance(item, text):
    """Plain dynamic programme: least edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    return min(row)


def test_against_dynamic_programme():
    rng = random.Random(1)
    for trial in range(120):
        item = "".join(rng.choice("abcd ") for _ in range(rng.randrange(24, 90)))
        item = dc.normalise(item)
        noisy = list(item)
        for _ in range(rng.randrange(0, 14)):
            at = rng.randrange(len(noisy))
            noisy[at : at + 1] = rng.choice([[], ["x"], [noisy[at], "y"]])
        text = dc.normalise("".join(rng.choice("abcd ") for _ in range(60)) + "".join(noisy) + "".join(rng.choice("abcd ") for _ in range(60)))
        got = dc.Matcher([item], 0.1).match(text).get(0)
        want = least_distance(item, text)
        assert (got[0] if got else None) == (want if want <= int(len(item) * 0.1) else None)


def test_planted_items_are_found_and_clean_rows_are_not(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    pdf = documents(spark, sf)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    got = {(r["doc_id"], r["item_id"]) for r in dc.op8_decontamination(spark, sf).collect()}
    texts = {d: dc.normalise(t) for d, t in zip(pdf.doc_id, pdf.text)}
    exact = {(d, i) for i, t in zip(items.item_id, items.text) for d, x in texts.items() if dc.normalise(t) in x}
    assert exact and exact <= got
    wanted = dict(zip(items.item_id, items.text))
    for d, i in got - exact:
        assert least_distance(dc.normalise(wanted[i]), texts[d]) <= 0.1 * len(wanted[i])


def test_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (None, item), (1, item)], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, item.upper().replace(" ", " \n ")), (3, item), (4, "clean words only " * 2000), (5, "pad " * 30000 + item.replace("fox", "cat") + " pad" * 30000)]
    df = docs(spark, rows).withColumn("distance", dc.F.lit("clash"))
    got = sorted((r["doc_id"], r["item_id"] or -1, r["distance"]) for r in dc.find_matches(df, bench).collect())
    assert got == sorted([(3, 1, 0), (3, -1, 0), (3, 1, 0)] * 2 + [(5, 1, 3), (5, -1, 3), (5, 1, 3)])
    left = dc.drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 4]
    assert dc.find_matches(df, bench.filter("false")).count() == 0
    assert dc.find_matches(docs(spark, []), bench).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_CHARS", 60)
    items = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(4)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs(spark, [(i, f"a b {t} c d") for i, t in enumerate(items)] + [(9, "clean")])
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.find_matches(df, bench).collect()) == [(i, i) for i in range(4)]
    assert [r["doc_id"] for r in dc.drop_contaminated(df, bench).collect()] == [9]


def test_short_items_match_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "cat"), (3, "  "), (4, "C++")], "item_id long, text string")
    rows = [(1, "Quiz: who wrote  hamlet? Shakespeare."), (2, "who wrote hamlets"), (3, "a concatenation"), (4, "the CAT, asleep"), (5, "who wrote hamlet"), (6, "learn c++ now"), (7, "cat")]
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in dc.find_matches(docs(spark, rows), bench).collect())
    assert got == [(1, 1, 0), (4, 2, 0), (6, 4, 0), (7, 2, 0)]
    assert sorted(r["doc_id"] for r in dc.drop_contaminated(docs(spark, rows), bench).collect()) == [2, 3, 5]


def test_edited_items_of_the_table_are_found(spark, sf_dir):
    """Recall by number of edits: every item, edited at random within its budget, inside other text."""
    rng = random.Random(7)
    items = [(r["item_id"], dc.normalise(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    matcher = dc.Matcher([t for _, t in items], dc.ERROR_RATE)
    for number, (_, item) in enumerate(items):
        for share in (0.0, 0.3, 0.6, 1.0):
            noisy = list(item)
            for at in sorted(rng.sample(range(len(item)), int(share * int(len(item) * dc.ERROR_RATE))), reverse=True):
                noisy[at : at + 1] = rng.choice([[], ["~"], [noisy[at], "~"]])
            hit = matcher.match(f"some words before {''.join(noisy)} and some after").get(number)
            assert hit and hit[0] <= int(len(item) * dc.ERROR_RATE)
