"""Operator 10, quality rules: hashed n-gram log-likelihood ratio (native).

Word unigrams and bigrams are hashed into ``buckets`` buckets. Two multinomials over the buckets
are estimated: the raw corpus's with add-one smoothing, the trusted target's with a Dirichlet prior of
``buckets`` pseudo-counts spread like the raw one, so that a bucket with little evidence has ratio 1. A document's score is the sum over its n-grams of log(target / raw), divided by their
number; every document at or above the threshold is kept, the others are not. Two base rules come
first: at least 50 words, and at most half of the words in repeated 3-word windows.

The raw model counts every n-gram of every document. The trusted target is a bounded sample of the
documents labelled good (``max_trusted`` of them, those with the smallest id hashes), so its ids can
be broadcast. The model is ``buckets`` numbers whatever the input, and scoring is a map without a
shuffle: the weights are a constant of the plan.

Defined results for odd input: a null or blank text has no words, score 0 and fails the base rules;
a table without trusted documents has score 0 everywhere, so that only the base rules decide;
repeated rows are judged one by one; columns of the input named like an output are replaced.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, let, table, text_or_empty, word_array

BUCKETS = 8192
MAX_TRUSTED = 20_000
THRESHOLD = -0.055
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"


def word_hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def _bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def _positions(first: int, hashes: Column) -> Column:
    """Positions first .. size-1, none if there are too few elements."""
    n = F.size(hashes)
    return F.when(n > first, F.sequence(F.lit(first), n - 1)).otherwise(F.array().cast("array<int>"))


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of all unigrams and bigrams of an array of word hashes."""
    return F.concat(
        F.transform(hashes, lambda h: _bucket(h, buckets)),
        F.transform(_positions(1, hashes), lambda i: _bucket(F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i)), buckets)),
    )


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """At most ``max_trusted`` doc_ids labelled good and not toxic, in order of a hash of the id."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def fit_log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(target / raw) per bucket: the model, of ``buckets`` numbers."""
    marks = trusted.select(F.col("doc_id").alias("__ls_id"), F.lit(1).alias("__ls_good"))
    marked = docs.select("doc_id", text_or_empty("text").alias("__ls_text")).join(
        F.broadcast(marks), F.col("doc_id") == F.col("__ls_id"), "left"
    )
    grams = marked.select(
        F.coalesce("__ls_good", F.lit(0)).alias("good"),
        F.explode(let(word_hashes(F.col("__ls_text")), lambda h: ngram_buckets(h, buckets))).alias("bucket"),
    )
    # at most buckets rows reach the driver
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).collect()
    raw_total = sum(r["raw"] for r in counts) + buckets
    target_total = sum(r["target"] for r in counts) + buckets
    ratios = [0.0] * buckets
    for r in counts:
        raw = (r["raw"] + 1) / raw_total
        ratios[r["bucket"]] = log((r["target"] + buckets * raw) / target_total) - log(raw)
    return ratios


def repeated_words(hashes: Column) -> Column:
    """Words that stand in a 3-word window found twice or more, the first occurrence included."""
    windows = F.transform(
        _positions(2, hashes), lambda i: F.xxhash64(F.get(hashes, i - 2), F.get(hashes, i - 1), F.get(hashes, i))
    )

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda e, j: e["x"].eqNullSafe(F.get(s, j - 1)["x"]) | e["x"].eqNullSafe(F.get(s, j + 1)["x"]),
            )
            return F.array_sort(F.transform(twice, lambda e: e["i"]))

        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        total = F.aggregate(
            let(ordered, starts),
            zero,
            lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + (p + 3) - F.greatest(acc["end"], p)).cast("long").alias("n")),
        )
        return F.when(F.size(F.array_distinct(w)) < F.size(w), total["n"]).otherwise(F.lit(0).cast("long"))

    return let(windows, covered)


def base_columns(text: Column) -> dict[str, Column]:
    """Columns that need no hashes: word_chars, n_symbols and n_dup_lines."""
    full = F.char_length(text)
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return {
        "word_chars": F.char_length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (full - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def judge(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Add the base columns, llr_score, base_failed and kept to every document."""
    buckets = len(ratios)
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")

    def measures(h: Column) -> Column:
        single = F.aggregate(h, F.lit(0.0), lambda acc, x: acc + F.get(weights, _bucket(x, buckets)))
        pairs = F.aggregate(
            _positions(1, h),
            F.lit(0.0),
            lambda acc, i: acc + F.get(weights, _bucket(F.xxhash64(F.get(h, i - 1), F.get(h, i)), buckets)),
        )
        return F.struct(
            F.size(h).cast("long").alias("n"), (single + pairs).alias("ratio"), repeated_words(h).alias("repeated")
        )

    text = text_or_empty("text")
    outputs = ("n_words", "n_repeat_words", "llr_score", "base_failed", "kept", "word_chars", "n_symbols", "n_dup_lines")
    bare = docs.drop(*outputs).withColumn("__ls_m", let(word_hashes(text), measures))
    n, m = F.col("n_words"), F.col("__ls_m")
    return (
        bare.withColumns({"n_words": m["n"], "n_repeat_words": m["repeated"], **base_columns(text)})
        .withColumn("llr_score", F.when(n > 0, m["ratio"] / (2 * n - 1)).otherwise(F.lit(0.0)))
        .withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr_score") >= threshold))
        .drop("__ls_m")
    )


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Fit the two models on ``docs`` and ``labels`` and judge every document."""
    return judge(docs, fit_log_ratios(docs, trusted_ids(labels), buckets), threshold)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every whole text of documents."""
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_score"
    )
