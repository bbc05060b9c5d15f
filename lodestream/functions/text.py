"""Tokens, token sets and text rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def alnum_tokens(text: str | Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9]+"), F.lit(0))


def space_tokens(text: str | Column) -> Column:
    """Lower-cased text without punctuation, cut at single spaces; empty tokens stay."""
    return F.split(F.regexp_replace(F.lower(_c(text)), r"(?U)[^\w\s]", ""), " ")


def collapse_blanks(text: str | Column) -> Column:
    return F.btrim(F.regexp_replace(_c(text), r"\s+", " "))


def shorten(text: str | Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three of them dots if anything is cut."""
    t = _c(text)
    return F.when(F.char_length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t)


def first_filled(*columns: str | Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in columns])


def stem(token: Column, exceptions: Mapping[str, str] | None = None) -> Column:
    """Strip one suffix of a token longer than five characters; ``exceptions`` come first."""
    out = token
    for suffix in reversed(("ing", "ed", "es", "s")):
        cut = F.substring(token, F.lit(1), F.length(token) - len(suffix))
        out = F.when((F.length(token) > 5) & token.endswith(suffix), cut).otherwise(out)
    for word, value in (exceptions or {}).items():
        out = F.when(token == word, F.lit(value)).otherwise(out)
    return out


def long_words(text: str | Column) -> Column:
    """Words of two or more ASCII letters, digits and apostrophes, lower-cased, without outer
    apostrophes."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit("[a-z0-9][a-z0-9']+"), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.btrim(t, F.lit("'"))), lambda t: F.length(t) >= 2)


def _not_in(words: Sequence[str]):
    stop = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    return lambda t: ~F.array_contains(stop, t)


def content_tokens(text: str | Column, stopwords: Sequence[str], exceptions: Mapping[str, str] | None = None) -> Column:
    """Different stemmed long words of a text that are no stopwords before or after stemming, sorted."""
    keep = _not_in(stopwords)
    stems = F.transform(F.filter(long_words(text), keep), lambda t: stem(t, exceptions))
    return F.array_sort(F.array_distinct(F.filter(stems, keep)))


def retrieval_tokens(text: str | Column, stopwords: Sequence[str], exceptions: Mapping[str, str] | None = None) -> Column:
    """Stemmed long words of a text in order, repeats kept, without stopwords."""
    return F.transform(F.filter(long_words(text), _not_in(stopwords)), lambda t: stem(t, exceptions))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def coverage(needed: Column, found: Column) -> Column:
    """Share of the needed tokens that were found; 0 if none is needed."""
    return overlap(needed, found) / F.greatest(F.lit(1), F.size(needed))


def has_any(text: str | Column, needles: Sequence[str]) -> Column:
    """Any needle occurs: as a substring if it has a blank, slash or hyphen, else as a whole word."""
    t = F.lower(_c(text))
    out = F.lit(False)
    for needle in needles:
        if any(c in needle for c in " /-"):
            out = out | t.contains(needle)
        else:
            out = out | t.rlike(rf"(^|[^a-z0-9_]){needle}($|[^a-z0-9_])")
    return out


def snippet(text: str | Column, term: str | Column, window: int) -> Column:
    """The text ``window`` characters around the first occurrence of a term; null without one."""
    t, at = _c(text), F.instr(_c(text), term)
    begin = F.greatest(at - window, F.lit(1))
    return F.when(at > 0, F.substring(t, begin, at - begin + window + (F.length(term) if isinstance(term, Column) else len(term))))


def choice_strict(text: str | Column, choices: str = "abcde") -> Column:
    """Index of the first character left after stripping stars, blanks and the letters of "option"."""
    cleaned = F.btrim(F.btrim(F.lower(_c(text)), F.lit("*")), F.lit("option "))
    at = F.position(F.substring(cleaned, 1, 1), F.lit(choices))
    return F.when((F.length(cleaned) > 0) & (at > 0), at - 1)


def choice_loose(text: str | Column, choices: str = "abcde", strip: Sequence[str] = ()) -> Column:
    """Index of the first choice letter standing alone, or else of the first at all, after the phrases
    of ``strip`` are taken out in order."""
    t = F.lower(_c(text))
    for phrase in strip:
        t = F.replace(t, F.lit(phrase), F.lit(""))
    alone = F.nullif(F.regexp_extract(t, rf"\b([{choices}])\b", 1), F.lit(""))
    anywhere = F.nullif(F.regexp_extract(t, rf"([{choices}])", 1), F.lit(""))
    letter = F.coalesce(alone, anywhere)
    return F.when(letter.isNotNull(), F.position(letter, F.lit(choices)) - 1)


def expand_options(question: str | Column, answer: str | Column) -> Column:
    """The texts of the options that an answer like ``A-C`` lists, cut out of ``A) ... B) ...``; any
    other answer as it is, blanks collapsed. An option that occurs twice has its last text."""
    q, a = _c(question), collapse_blanks(answer)
    letters = F.regexp_extract_all(q, F.lit(r"\b([A-E])\)\s*"), F.lit(1))
    texts = F.slice(F.split(q, r"\b[A-E]\)\s*"), F.lit(2), F.greatest(F.size(letters), F.lit(0)))
    pairs = F.arrays_zip(letters.alias("l"), texts.alias("t"))
    named = lambda x: F.try_element_at(F.filter(pairs, lambda p: p["l"] == x), F.lit(-1))["t"]
    clean = lambda t: collapse_blanks(F.btrim(t, F.lit(" ,.;")))
    listed = F.array_join(F.transform(F.split(a, "-"), lambda x: F.coalesce(clean(named(x)), F.lit(""))), " ")
    return F.when(a.rlike("^[A-E](-[A-E])*$"), F.when(listed == "", a).otherwise(listed)).otherwise(a)
