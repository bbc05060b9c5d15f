"""Gates of nested documents, against the cases that a validator of items has to tell apart."""

import copy
import json

import pytest

from lodestream.operators import validation as va

ITEM = {
    "qa_id": "1", "question": "q", "options": ["a", "b", "c", "d", "e"], "correct": "B", "answer": "b", "category": "x", "required_users": ["ann", "bob"], "evidence": [],
    "single_user_answerability": {"ann": "insufficient", "bob": "Not enough"}, "combined_answerability": "they support it",
    "review": {
        "review_passed": True, "status": "passed", "schema_validation": {"passed": True}, "answerability": {"gate": {"passed": True}, "evaluations": []},
        "judger": {"review_passed": True, "gate": {"passed": True}, "checks": {c: {"status": "pass"} for c in va.JUDGE_CHECKS}},
    },
    "model_id": "m", "source_urls": [], **{f: "x" for f in va.STRICT_ITEM_FIELDS}, "question_type": "commonality", "video_evidence": [1], "generation_trace": [{}], "human_audit": {},
}


def problems(spark, item, strict):
    text = item if isinstance(item, str) else json.dumps(item)
    rows = va.validate(spark.createDataFrame([(1, text)], "id int, j string"), "id", "j", va.choice_item(), strict).collect()
    return sorted((r["path"], r["rule"]) for r in rows)


def changed(path, value):
    item = copy.deepcopy(ITEM)
    *way, last = path.split(".")
    place = item
    for step in way:
        place = place[step]
    if value is KeyError:
        del place[last]
    else:
        place[last] = value
    return item


CASES = [
    ("question_type", KeyError, [], [("$", "missing strict fields")]),
    ("question_type", "difference", [], []),
    ("question_type", "other", [("$.question_type", "must be commonality or difference")], None),
    ("review.judger", {"review_passed": True, "gate": {"passed": True}}, [], [("$.review.judger.checks", "must be an object")]),
    ("review.answerability.gate", {"passed": False}, [], [("$.review.answerability.gate.passed", "must be true")]),
    ("review.judger.checks.gaze_safety", "PASS", [], [("$.review.judger.checks.gaze_safety", "must be an object")]),
    ("review.judger.checks.gaze_safety", KeyError, [], [("$.review.judger.checks", "missing fields")]),
    ("review.review_passed", "true", [], [("$.review.review_passed", "must be true")]),
    ("review", None, [("$.review", "must be an object")], None),
    ("required_users", ["ann"], [("$.required_users", "must have at least 2 entries")], None),
    ("required_users", "ann", [("$.required_users", "must have at least 2 entries")], None),
    ("required_users", ["ann", "eve"], [("$.single_user_answerability.eve", "must be marked insufficient")], None),
    ("correct", 1, [], []),
    ("correct", 7, [("$.correct", "names no option")], None),
    ("correct", "option b", [], []),
    ("correct", "C", [("$.answer", "must equal options[correct]")], None),
    ("options", ["a", "b", "c", "d", 5], [("$.options", "entries must be texts")], None),
    ("video_evidence", [], [], [("$.video_evidence", "must have at least 1 entries")]),
]


@pytest.mark.parametrize("strict", [False, True])
def test_cases(spark, strict):
    assert problems(spark, ITEM, strict) == []
    assert problems(spark, "{broken", strict) == [("$", "is no JSON")]
    assert problems(spark, "[1]", strict) == [("$", "must be an object")]
    for path, value, plain, with_review in CASES:
        want = plain if not strict or with_review is None else with_review
        assert problems(spark, changed(path, value), strict) == want, (path, value)
