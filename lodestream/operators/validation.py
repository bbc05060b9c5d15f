"""Validation of nested documents of unknown shape: a schema of gates, evaluated to (path, rule, value) rows.

A document is a VARIANT; a gate is a check of one place in it. Gates nest: those below an object or list count only if
it is there, so one missing object is one problem. ``strict`` gates apply in strict mode only. The schema is turned into
one expression of built-in functions, so documents are judged where they are read; broken JSON is the one problem of its row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBLEM = "struct<path:string,rule:string,value:string>"


def at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def kind(value: Column) -> Column:
    """OBJECT..., ARRAY..., STRING and so on; null for what is missing, VOID for a JSON null."""
    return F.schema_of_variant(value)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def is_list(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("ARRAY"), F.lit(False))


def text_of(doc: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(doc, path, "string"), F.lit(""))


def items_of(doc: Column, path: str) -> Column:
    """The elements of a list; an empty array if it is none."""
    return F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>"))


def fields_of(doc: Column, path: str) -> Column:
    """Names of the fields of an object; an empty array if it is none."""
    return F.coalesce(F.map_keys(F.try_variant_get(doc, path, "map<string,variant>")), F.array().cast("array<string>"))


def _problem(path: Column | str, rule: Column | str, value: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(path).alias("path"), lit(rule).alias("rule"), (F.lit(None).cast("string") if value is None else value).alias("value"))


def _none() -> Column:
    return F.array().cast(f"array<{PROBLEM}>")


def _one(broken: Column, path: str, rule: Column | str, value: Column | None = None) -> Column:
    return F.when(broken, F.array(_problem(path, rule, value))).otherwise(_none())


class Gate:
    strict = False

    def problems(self, doc: Column, path: str, strict: bool) -> list[Column]:
        """Arrays of problems."""
        raise NotImplementedError

    def check(self, doc: Column, path: str, strict: bool) -> Column:
        parts = [] if self.strict and not strict else self.problems(doc, path, strict)
        return F.concat(*parts) if parts else _none()


@dataclass
class Obj(Gate):
    """An object that has the fields ``needs``, and no others if ``exact``; ``strict_needs`` in strict mode."""

    fields: Mapping[str, Gate] = field(default_factory=dict)
    needs: Sequence[str] = ()
    strict_needs: Sequence[str] = ()
    exact: bool = False
    strict: bool = False

    def problems(self, doc: Column, path: str, strict: bool) -> list[Column]:
        value, names = at(doc, path), fields_of(doc, path)
        inner = []
        for needs, what in ((self.needs, "missing fields"), (self.strict_needs if strict else (), "missing strict fields")):
            if needs:
                missing = F.array_sort(F.array_except(F.array(*[F.lit(n) for n in needs]), names))
                inner.append(_one(F.size(missing) > 0, path, what, F.array_join(missing, ", ")))
        if self.exact:
            more = F.array_sort(F.array_except(names, F.array(*[F.lit(n) for n in self.needs])))
            inner.append(_one(F.size(more) > 0, path, "unknown fields", F.array_join(more, ", ")))
        inner += [gate.check(doc, f"{path}.{name}", strict) for name, gate in self.fields.items()]
        within = F.concat(*inner) if inner else _none()
        return [F.when(is_object(value), within).otherwise(F.array(_problem(path, "must be an object")))]


@dataclass
class Items(Gate):
    """A list; ``texts``: of texts that aren't blank, ``distinct``: without repeats."""

    exactly: int | None = None
    at_least: int = 0
    texts: bool = False
    distinct: bool = False
    strict: bool = False

    def problems(self, doc: Column, path: str, strict: bool) -> list[Column]:
        value, items = at(doc, path), items_of(doc, path)
        n = F.size(items)
        wrong = (n != self.exactly) if self.exactly is not None else (n < self.at_least)
        rule = f"must have exactly {self.exactly} entries" if self.exactly is not None else f"must have at least {self.at_least} entries"
        first = ~is_list(value) | wrong
        out = [_one(first, path, rule)]
        as_text = F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))
        if self.texts:
            bad = F.exists(items, lambda x: (kind(x) != "STRING") | (F.btrim(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))) == ""))
            out.append(_one(~first & bad, path, "entries must be texts"))
        if self.distinct:
            out.append(_one(~first & (F.size(F.array_distinct(as_text)) < n), path, "entries must differ"))
        return out


@dataclass
class Holds(Gate):
    """A value for which ``test`` holds."""

    test: Callable[[Column, str], Column]
    rule: str
    strict: bool = False

    def problems(self, doc: Column, path: str, strict: bool) -> list[Column]:
        return [_one(~F.coalesce(self.test(doc, path), F.lit(False)), path, self.rule, F.try_variant_get(doc, path, "string"))]


@dataclass
class Entries(Gate):
    """An object that has the fields ``needs``, all of whose fields are objects with a text ``name`` that is ``value``."""

    needs: Sequence[str]
    name: str
    value: str
    strict: bool = False

    def problems(self, doc: Column, path: str, strict: bool) -> list[Column]:
        entries = F.coalesce(F.map_entries(F.try_variant_get(doc, path, "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
        own = lambda e: F.concat(F.lit(f"{path}."), e["key"])
        wrong = lambda e: F.upper(F.coalesce(F.try_variant_get(e["value"], f"$.{self.name}", "string"), F.lit(""))) != self.value
        not_object = F.transform(F.filter(entries, lambda e: ~is_object(e["value"])), lambda e: _problem(own(e), "must be an object"))
        not_value = F.transform(F.filter(entries, lambda e: is_object(e["value"]) & wrong(e)), lambda e: _problem(own(e), f"{self.name} must be {self.value}"))
        inner = Obj(needs=self.needs).problems(doc, path, strict)
        return [*inner, F.when(is_object(at(doc, path)), F.concat(not_object, not_value)).otherwise(_none())]


def true(strict: bool = False) -> Gate:
    return Holds(lambda doc, path: F.try_variant_get(doc, path, "boolean") & (kind(at(doc, path)) == "BOOLEAN"), "must be true", strict)


def validate(rows: DataFrame, id_col: str, json_col: str, schema: Gate, strict: bool = False) -> DataFrame:
    """(id, path, rule, value) of every broken gate of every document."""
    parsed = rows.select(id_col, F.try_parse_json(F.col(json_col).cast("string")).alias("doc"))
    found = F.when(F.col("doc").isNull(), F.array(_problem("$", "is no JSON"))).otherwise(schema.check(F.col("doc"), "$", strict))
    return parsed.select(id_col, F.inline(found.cast(f"array<{PROBLEM}>")))


# items of multiple choice

# Field names, letters and words that results have to match.
LETTERS = ("A", "B", "C", "D", "E")
ITEM_FIELDS = (
    "qa_id", "question", "options", "correct", "answer", "category", "required_users", "evidence", "single_user_answerability",
    "combined_answerability", "review", "model_id", "source_urls",
)
STRICT_ITEM_FIELDS = (
    "question_type", "generator_rationale", "why_two_users_needed", "per_user_evidence_claims", "attempt_count", "video_evidence",
    "referred_timestamps", "human_audit", "generation_trace",
)
JUDGE_CHECKS = (
    "first_person_naturalness", "agent_perspective", "source_scope", "question_type_semantics", "multi_video_necessity", "visual_grounding",
    "mcq_option_quality", "gaze_safety", "human_auditability",
)
NOT_ALONE = ("insufficient", "cannot", "not enough")
TOGETHER = ("sufficient", "support")
QUESTION_TYPES = ("commonality", "difference")


def _has_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(F.lower(text), F.lit(word))
    return out


def correct_place(doc: Column, path: str) -> Column:
    """The place, from 0, of the option that a number or a text with a letter names; null if it names none."""
    number = F.when(kind(at(doc, path)) == "BIGINT", F.try_variant_get(doc, path, "int"))
    text = F.upper(F.btrim(text_of(doc, path)))
    letter = F.coalesce(F.when(text.isin(*LETTERS), text), F.nullif(F.regexp_extract(text, r"\b([A-E])\b", 1), F.lit("")))
    of_letter = F.position(letter, F.lit("".join(LETTERS))) - 1
    return F.coalesce(F.when(number.between(0, len(LETTERS) - 1), number), of_letter)


def _answer_fits(doc: Column, path: str) -> Column:
    options, place = items_of(doc, "$.options"), correct_place(doc, "$.correct")
    open_ = place.isNull() | (F.size(options) != len(LETTERS))
    return open_ | F.coalesce(F.try_variant_get(F.get(options, place), "$", "string") == F.try_variant_get(doc, path, "string"), F.lit(False))


class _AloneInsufficient(Gate):
    """Every required user has a text that says that it can't be answered by that user alone."""

    def problems(self, doc: Column, path: str, strict: bool) -> list[Column]:
        users = F.transform(items_of(doc, "$.required_users"), lambda u: F.try_variant_get(u, "$", "string"))
        said = F.try_variant_get(doc, path, "map<string,variant>")
        text = lambda u: F.coalesce(F.try_variant_get(F.try_element_at(said, u), "$", "string"), F.lit(""))
        wrong = F.filter(users, lambda u: ~_has_any(text(u), NOT_ALONE))
        each = F.transform(wrong, lambda u: _problem(F.concat(F.lit(f"{path}."), u), "must be marked insufficient"))
        return [F.when(is_object(at(doc, path)), each).otherwise(F.array(_problem(path, "must be an object")))]


def choice_item() -> Gate:
    """The gates of a question with five options about two users or more; review gates are strict."""
    gate = Obj({"passed": true()})
    judger = Obj({"review_passed": true(), "gate": gate, "checks": Entries(JUDGE_CHECKS, "status", "PASS")}, strict=True)
    review = Obj({
        "review_passed": true(strict=True),
        "status": Holds(lambda d, p: text_of(d, p) == "passed", "must be passed", strict=True),
        "judger": judger,
        "answerability": Obj({"gate": gate, "evaluations": Items()}, strict=True),
        "schema_validation": Obj({"passed": true()}, strict=True),
    })
    return Obj(
        {
            "options": Items(exactly=len(LETTERS), texts=True),
            "correct": Holds(lambda d, p: correct_place(d, p).isNotNull(), "names no option"),
            "answer": Holds(_answer_fits, "must equal options[correct]"),
            "required_users": Items(at_least=2, distinct=True),
            "single_user_answerability": _AloneInsufficient(),
            "combined_answerability": Holds(lambda d, p: _has_any(text_of(d, p), TOGETHER), "must state sufficient support"),
            "question_type": Holds(lambda d, p: kind(at(d, p)).isNull() | (kind(at(d, p)) == "VOID") | text_of(d, p).isin(*QUESTION_TYPES), "must be commonality or difference"),
            "video_evidence": Items(at_least=1, strict=True),
            "generation_trace": Items(at_least=1, strict=True),
            "human_audit": Obj(strict=True),
            "review": review,
        },
        needs=ITEM_FIELDS, strict_needs=STRICT_ITEM_FIELDS,
    )


def question_entry() -> Gate:
    """An entry of a question file: exactly id, query and answers a to d."""
    return Obj(
        {
            "id": Holds(lambda d, p: (kind(at(d, p)) == "STRING") & text_of(d, p).startswith("2026_q"), "must begin with 2026_q"),
            "query": Holds(lambda d, p: (kind(at(d, p)) == "STRING") & (F.btrim(text_of(d, p)) != ""), "must be a text"),
            "answers": Obj(needs=("a", "b", "c", "d"), exact=True),
        },
        needs=("id", "query", "answers"), exact=True,
    )
