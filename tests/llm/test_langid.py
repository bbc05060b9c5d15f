import math
from collections import Counter

import numpy as np
from helpers import docs, documents

from lodestream.llm import langid


def runs(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        else:
            if word:
                out.append(word)
            word = ""
    return out


def brute_model(rows):
    languages = sorted({lang for _, lang in rows})
    words, grams = Counter(), {n: Counter() for n in langid.ORDERS}
    for lang in languages:
        found = [w for text, own in rows if own == lang for w in runs(text)]
        words.update((lang, w) for w in found)
        for w in found:
            marked = "^" + w + "$"
            for n in langid.ORDERS:
                for i in range(len(marked) - 1):
                    if len(marked) - i >= n:
                        grams[n][lang, marked[i : i + n].replace("^", "$")] += 1
    return languages, words, grams


def brute_scores(model, text):
    languages, words, grams = model

    def log(counter, lang, item):
        total = sum(v for (own, _), v in counter.items() if own == lang)
        kinds = len({i for _, i in counter})
        return math.log((counter[lang, item] + 0.5) / (total + 0.5 * (kinds + 1)))

    out = {}
    for lang in languages:
        total = 0.0
        for w in runs(text):
            if any((x, w) in words for x in languages):
                total += log(words, lang, w)
                continue
            marked, parts = "$" + w + "$", []
            for i in range(len(marked) - 1):
                for n in langid.ORDERS:
                    g = marked[i : i + n]
                    if len(g) == n and any((x, g) in grams[n] for x in languages):
                        parts.append(log(grams[n], lang, g))
                        break
                else:
                    parts.append(log(grams[1], lang, "?none"))
            total += sum(parts) / len(parts)
        out[lang] = total
    return out


def test_scores_against_brute_force(spark):
    rows = [("the cat and the dog sat", "en"), ("le chat et le chien", "fr"), ("die Katze und der Hund, ÜBER", "de"), ("cats and dogs the", "en")]
    train = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    model, want = langid.fit(train), brute_model(rows)
    for text in ("the chat", "kathedral über dogma", "zzz", "catte chienne-hundert x"):
        reader = langid.LetterReader()
        values, doc, start, end, hashed = reader.words([text])
        got = langid.score_words(model, values, start, end, hashed).sum(axis=0)
        assert np.allclose(got, [brute_scores(want, text)[x] for x in want[0]], atol=1e-3), text


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    truth = documents(spark, sf).set_index("doc_id").lang
    rows = langid.op3_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !! 4", None), (4, "hello there world", "en"), (4, "hello there world", "en"), (None, "bonjour le monde", "fr"), (6, "hello " * 60000, None), (7, "le monde", None)]
    df = docs(spark, rows).withColumn("lang_pred", langid.F.lit("clash"))
    train = df.filter("lang is not null and text is not null")
    got = langid.identify_languages(df, langid.fit(train)).collect()
    assert sorted(str((r["doc_id"], r["lang_pred"])) for r in got) == sorted(
        str(x) for x in [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "fr"), (6, "en"), (7, "fr")]
    )
    nothing = langid.identify_languages(df, langid.fit(train.filter("false"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and len(nothing) == len(rows)
    assert langid.identify_languages(docs(spark, []), langid.fit(train)).count() == 0


def test_words_beyond_the_lists_sent_count_in_full(spark, sf_dir):
    df = documents(spark, sf_dir).head(60)
    df = langid.checkpointed(spark.createDataFrame(df[["doc_id", "text", "lang"]]).repartition(3))
    train = df.filter("doc_id % 3 > 0").coalesce(1)
    results = [
        {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify_languages(df, langid.fit(train, *room), 20_000).collect()}
        for room in ((10**9, 10**9), (50, 20), (0, 0))
    ]
    assert len(results[0]) == 60
    for some in results[1:]:
        assert {k: v[0] for k, v in some.items()} == {k: v[0] for k, v in results[0].items()}
        assert all(math.isclose(v[1], results[0][k][1], abs_tol=1e-5) for k, v in some.items())


def test_the_model_does_not_depend_on_the_layout(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = []
    for parts in (1, 8):
        dealt = df.repartition(parts)
        model = langid.fit(dealt.filter("doc_id % 3 > 0 and lang is not null and text is not null"), 300, 200)
        rows = langid.identify_languages(dealt, model, 30_000 * parts).collect()
        found.append((model, {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}))
    (a, of_a), (b, of_b) = found
    for order in a.hashes:
        assert np.array_equal(a.hashes[order], b.hashes[order]) and np.array_equal(a.logs[order], b.logs[order])
    assert all(of_a[d][0] == of_b[d][0] and math.isclose(of_a[d][1], of_b[d][1], rel_tol=1e-9) for d in of_a)
