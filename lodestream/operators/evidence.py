"""How well retrieved evidence answers a question, and whether history adds to the current scope.

Thresholds and the order of rules are fixed values that results have to match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.decisions import best_option, decision_list

RANKS = {"likely": 3, "partial": 2, "unclear": 1, "not": 0}


def rank_of(label: Column) -> Column:
    return F.coalesce(*[F.when(label == name, F.lit(rank)) for name, rank in RANKS.items()])


def evidence_sets(ranked: DataFrame, docs: DataFrame, by: str, doc_id: str, text: str, stopwords: Sequence[str]) -> DataFrame:
    """(by, n_ranked, tokens, body): the ranked documents of each question, as content tokens and as
    lower-case text; a question has as many documents as were ranked."""
    found = docs.select(doc_id, F.coalesce(F.col(text), F.lit("")).alias("__t")).join(ranked.select(by, doc_id, "rank"), doc_id)
    rows = found.select(by, "rank", tx.content_tokens("__t", stopwords).alias("__k"), F.lower(tx.collapse_blanks("__t")).alias("__b"))
    in_order = F.sort_array(F.collect_list(F.struct("rank", "__b")))
    return rows.groupBy(by).agg(
        F.count("*").alias("n_ranked"), F.array_distinct(F.flatten(F.collect_list("__k"))).alias("tokens"),
        F.array_join(F.transform(in_order, lambda s: s["__b"]), " ").alias("body"),
    )


def assess(asked: DataFrame, sets: DataFrame, by: str, question: Column, answer: Column, stopwords: Sequence[str], broad: str, exhaustive: str) -> DataFrame:
    """``asked`` with n_ranked, coverage, overlap, hits, direct, label and reason.

    ``broad`` and ``exhaustive`` are patterns of questions that need more than a local passage: about
    everything, and about every single case.
    """
    expanded, plain = tx.expand_options(question, answer), F.lower(tx.collapse_blanks(answer))
    raw = F.when((F.length(plain) > 1) & ~plain.rlike("^[a-e](-[a-e])*$"), plain).otherwise("")
    need = F.array_union(tx.content_tokens(expanded, stopwords), tx.content_tokens(raw, stopwords))
    none = F.array().cast("array<string>")
    prepared = asked.withColumns({
        "__need": need, "__asks": tx.content_tokens(question, stopwords), "__plain": plain,
        "__broad": F.lower(question).rlike(broad), "__every": F.lower(question).rlike(exhaustive),
    })
    met = prepared.join(sets, by, "left").withColumns({
        "n_ranked": F.coalesce("n_ranked", F.lit(0)), "__have": F.coalesce("tokens", none), "__body": F.coalesce("body", F.lit("")),
    })
    hits = F.array_sort(F.array_intersect("__need", "__have"))
    direct = (F.length("__plain") > 2) & ~F.col("__plain").rlike(r"^\d+(\.\d+)?$") & F.contains(F.col("__body"), F.col("__plain"))
    met = met.withColumns({"hits": hits, "overlap": F.size(F.array_intersect("__asks", "__have")), "direct": direct})
    met = met.withColumn("coverage", F.size("hits") / F.greatest(F.lit(1), F.size("__need")))
    c, q, n, is_broad, every = (F.col(x) for x in ("coverage", "overlap", "n_ranked", "__broad", "__every"))
    rules = [
        (F.btrim("__body") == "", "not", "no evidence"),
        (is_broad & ~every & (c >= 0.85) & (q >= 6) & (n >= 6), "likely", "broad question, broad evidence"),
        (is_broad & (c >= 0.55) & (q >= 3) & every, "partial", "every case needed, evidence is a selection"),
        (is_broad & (c >= 0.55) & (q >= 3), "partial", "broad question, evidence may miss events"),
        (is_broad & ((q >= 4) | (c >= 0.25)), "unclear", "broad question, some words in common"),
        (is_broad, "not", "broad question, evidence too narrow"),
        (F.col("direct") & (q >= 2), "likely", "answer found as a phrase"),
        ((c >= 0.70) & (q >= 2), "likely", "most answer words found"),
        ((c >= 0.50) & (q >= 5), "likely", "half the answer words and much of the question found"),
        ((c >= 0.35) & (q >= 2), "partial", "some answer words found"),
        ((c > 0) | (q >= 4), "unclear", "words in common only"),
    ]
    label = decision_list([(rule, name) for rule, name, _ in rules], "not")
    reason = decision_list([(rule, why) for rule, _, why in rules], "nothing relevant")
    return met.withColumns({"label": label, "reason": reason}).drop("__need", "__asks", "__plain", "__broad", "__every", "__have", "__body", "tokens", "body")


def gain_label(now: Column, past: Column, plus: Column) -> Column:
    """Whether history adds: from structs (label, coverage, overlap, hits) of the three scopes."""
    was, is_ = rank_of(now["label"]), rank_of(plus["label"])
    relevant = past["label"].isin("likely", "partial") | ((past["label"] == "unclear") & ((past["coverage"] >= 0.20) | (past["overlap"] >= 4)))
    added = (F.size(F.array_except(plus["hits"], now["hits"])) > 0) | (plus["overlap"] >= now["overlap"] + 2)
    return decision_list(
        [
            ((is_ > was) & (is_ >= 2) & relevant, "yes"),
            ((is_ > was) & relevant, "promising"),
            ((now["label"] == "likely") & (is_ <= was), "no"),
            ((is_ >= was) & (plus["label"] != "not") & relevant & added, "promising"),
            (is_ == was, "no"),
        ],
        "unclear",
    )


def best_scope(now: Column, past: Column, plus: Column) -> Column:
    """The scope of the highest label; ties go to both together, then to the current one."""
    return best_option({"plus": rank_of(plus["label"]), "current": rank_of(now["label"]), "history": rank_of(past["label"])})
