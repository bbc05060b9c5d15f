"""Ordered keyword rules, pattern sets and the rebuilding of keys, as column expressions.

Dictionaries are parameters. The pattern sets below are the defaults.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import timefns as tm
from .decisions import reasons

# Questions about more than one passage, and those that need every single case.
BROAD_PATTERNS = (
    r"\bwho\s+used\b.*\bthe\s+most\b",
    r"\bthe\s+most\b",
    r"\bfirst\s+time\b",
    r"\blast\s+time\b",
    r"\bwhich\s+of\s+the\s+following\s+happened\s+(first|last)\b",
    r"\bcorrect\s+sequence\s+of\s+events\b",
    r"\bhow\s+many\b",
    r"\bnumber\s+of\b",
    r"\bfirst\s+person\b",
    r"\blast\s+person\b",
    r"\bwho\s+was\s+the\s+(first|last)\b",
    r"\bwhen\s+was\b.*\bused\s+the\s+most\b",
    r"\bbefore\s+\d{1,2}\s*(?:am|pm)\b",
    r"\bafter\s+\d{1,2}\s*(?:am|pm)\b",
)
EXHAUSTIVE_PATTERNS = (
    r"\bwho\s+used\b.*\bthe\s+most\b",
    r"\bwhen\s+was\b.*\bused\s+the\s+most\b",
    r"\bfirst\s+time\b",
    r"\blast\s+time\b",
    r"\bwhich\s+of\s+the\s+following\s+happened\s+(first|last)\b",
    r"\bcorrect\s+sequence\s+of\s+events\b",
    r"\bhow\s+many\b",
    r"\bnumber\s+of\b",
    r"\bfirst\s+person\b",
    r"\blast\s+person\b",
    r"\bwho\s+was\s+the\s+(first|last)\b",
)
# The form of an evidence line's head, and where the next begins.
EVIDENCE_SCOPES = "current_only|history_only|current_plus_historical"
EVIDENCE_HEAD = (
    rf"(?s)^\[({EVIDENCE_SCOPES})\s+rank=(\d+)\s+score=([-+]?\d+(?:\.\d+)?)\s+"
    r"source=([A-Za-z]+)\s+D(\d+)\s+([0-9:.]+)-([0-9:.]+)\s+([A-Za-z0-9]+)\]\s+(.*)$"
)
EVIDENCE_CUT = rf"\n(?=\[(?:{EVIDENCE_SCOPES})\s+rank=)"


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """A pattern of the set occurs in the lower-cased text."""
    return F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def first_label(text: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """The first label one of whose words the lower-cased text contains; null without one."""
    t = F.lower(text)
    return F.coalesce(*[F.when(contains_any(t, words), F.lit(label)) for label, words in rules.items()])


def all_labels(text: Column, rules: Sequence[tuple[Sequence[str], Sequence[str]]]) -> Column:
    """Labels of all rules (words, labels) that hold, in order, each once."""
    t, none = F.lower(text), F.array().cast("array<string>")
    found = [F.when(contains_any(t, words), F.array(*map(F.lit, labels))).otherwise(none) for words, labels in rules]
    return F.array_distinct(F.concat(*found))


def question_kind(text: Column, prefixes: Mapping[str, str], details: Mapping[str, Sequence[str]], otherwise: Column) -> Column:
    """The kind that a question's first words tell, else one its words tell, else another column."""
    t = F.ltrim(F.lower(text))
    begins = [F.when(t.startswith(p), F.lit(kind)) for p, kind in prefixes.items()]
    return F.coalesce(*begins, first_label(text, details), otherwise)


def evidence_lines(text: Column) -> Column:
    """Evidence lines with captions of any number of lines, as an array of structs; others are left out."""
    group = lambda line, i: F.regexp_extract(line, EVIDENCE_HEAD, i)
    parsed = F.transform(
        F.filter(F.split(text, EVIDENCE_CUT), lambda line: line.rlike(EVIDENCE_HEAD)),
        lambda line: F.struct(
            group(line, 1).alias("scope"), group(line, 2).cast("int").alias("rank"), group(line, 3).cast("double").alias("score"), group(line, 4).alias("source"),
            group(line, 5).cast("int").alias("day"), group(line, 6).alias("start"), group(line, 7).alias("end"), group(line, 8).alias("granularity"),
            F.btrim(F.regexp_replace(group(line, 9), r"\s+", " ")).alias("caption"),
        ),
    )
    return parsed


def resolve_clip(source: Column, day: Column, key: Column, start: Column, folders: Mapping[str, str]) -> Column:
    """(key, path, resolved, reason) of a clip: the key as given, else rebuilt from folder, day and start."""
    known = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
    folder, given, at = F.try_element_at(known, source), F.btrim(key), tm.clock_millis(start)
    hundredths = F.bround(at / 10).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    token = F.concat(two(F.floor(hundredths / 360_000)), two(F.floor(hundredths / 6_000) % 60), two(F.floor(hundredths / 100) % 60), two(hundredths % 100))
    rebuilt = F.concat(F.lit("DAY"), day, F.lit("_"), folder, F.lit("_"), token, F.lit(".mp4"))
    final = F.when(given != "", given).otherwise(F.coalesce(rebuilt, F.lit("")))
    resolved = folder.isNotNull() & (day != "") & (final != "")
    why = reasons(
        [
            (folder.isNull(), "unknown source"), (day == "", "missing day"),
            ((given == "") & (final != ""), "key rebuilt from source, day and start"), (final == "", "no key and too little to rebuild it"),
            (resolved & (given != ""), "resolved from the key"),
        ],
        "; ",
    )
    path = F.when(resolved, F.concat(folder, F.lit("/DAY"), day, F.lit("/"), final)).otherwise("")
    return F.struct(final.alias("key"), path.alias("path"), resolved.alias("resolved"), why.alias("reason"))


def frame_offset(target_ms: Column, key: Column, start_ms: Column, duration_ms: Column, margin_ms: int = 500) -> Column:
    """Where a target lies in its clip: from the start that the key tells, else from the other one, not
    before it and, if the clip's length is known, at least ``margin_ms`` before its end."""
    told = tm.loose_token_millis(F.regexp_extract(key, r"_(\d{6,8})\.mp4$", 1))
    offset = F.greatest(F.lit(0).cast("long"), target_ms - F.coalesce(told, start_ms))
    return F.when(duration_ms.isNull(), offset).otherwise(F.least(offset, F.greatest(duration_ms - margin_ms, F.lit(0).cast("long"))))


def completed(doc: Column, defaults: Mapping[str, str], letters: str = "ABCD") -> Column:
    """A question's JSON (category, correct, answer, options) with defaults for what is missing, and the
    answer overwritten by the text of the correct option if all options are there."""
    parsed = F.from_json(doc, "category string, correct string, answer string, options array<string>")
    correct = F.upper(F.btrim(parsed["correct"]))
    at = F.position(correct, F.lit(letters))
    valid = (F.length(correct) == 1) & (at > 0)
    whole = F.size(parsed["options"]) == len(letters)
    return F.struct(
        F.coalesce(parsed["category"], F.lit(defaults["category"])).alias("category"), F.when(valid, correct).otherwise(parsed["correct"]).alias("correct"),
        F.when(valid & whole, F.get(parsed["options"], at - 1)).otherwise(F.coalesce(parsed["answer"], F.lit(defaults["answer"]))).alias("answer"),
    )
