"""Validation of nested documents: items and question files are written as JSON from the tables, with faults spread by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validation as va
from ..sources.tables import load
from .registry import query

_FAULT = "(({id} * 7 + {k} * 13) % 10 = 0) AS b{k}"


def _faults(id_col: str, n: int) -> str:
    return ", ".join(_FAULT.format(id=id_col, k=k) for k in range(n))


_CHECKS = ", ".join(f"'{c}', named_struct('status', {'''if(b12, 'FAIL', 'pass')''' if c == 'gaze_safety' else '''"PASS"'''})" for c in va.JUDGE_CHECKS)
_ITEM = f"""to_json(named_struct(
  'qa_id', if(b0, null, 'qa'), 'question', '?',
  'options', if(b1, array('o1', 'o2', 'o3', 'o4'), if(b2, array('o1', ' ', 'o3', 'o4', 'o5'), array('o1', 'o2', 'o3', 'o4', 'o5'))),
  'correct', if(b3, 'Z9', 'it is (c)'), 'answer', if(b4, 'other', 'o3'), 'category', 'x',
  'required_users', if(b5, array('u1'), if(b6, array('u1', 'u1'), array('u1', 'u2'))), 'evidence', array('e'),
  'single_user_answerability', named_struct('u1', if(b7, 'can be answered', 'Insufficient'), 'u2', 'cannot tell'),
  'combined_answerability', if(b8, 'unclear', 'sufficient together'),
  'review', if(b13, null, named_struct('review_passed', true, 'status', 'passed',
    'judger', named_struct('review_passed', true, 'gate', named_struct('passed', not b11), 'checks', named_struct({_CHECKS})),
    'answerability', named_struct('gate', named_struct('passed', true), 'evaluations', array('x')), 'schema_validation', named_struct('passed', true))),
  'model_id', 'm', 'source_urls', array('s'), 'question_type', if(b9, 'mix', 'difference'), 'generator_rationale', 'r', 'why_two_users_needed', 'w',
  'per_user_evidence_claims', array('c'), 'attempt_count', 1, 'video_evidence', array('v'), 'referred_timestamps', array('t'),
  'human_audit', if(b10, null, named_struct('by', 'me')), 'generation_trace', array('g')))"""

_PLAIN_SQL = f"""
WITH c AS (SELECT DISTINCT conv_id FROM conversations), f AS (SELECT conv_id, {_faults('conv_id', 14)} FROM c),
p AS (
  SELECT conv_id, '$' AS path, 'missing fields' AS rule, concat_ws(', ', CASE WHEN b0 THEN 'qa_id' END, CASE WHEN b13 THEN 'review' END) AS value FROM f WHERE b0 OR b13
  UNION ALL SELECT conv_id, '$.options', 'must have exactly 5 entries', NULL FROM f WHERE b1
  UNION ALL SELECT conv_id, '$.options', 'entries must be texts', NULL FROM f WHERE b2 AND NOT b1
  UNION ALL SELECT conv_id, '$.correct', 'names no option', 'Z9' FROM f WHERE b3
  UNION ALL SELECT conv_id, '$.answer', 'must equal options[correct]', 'other' FROM f WHERE b4 AND NOT b1 AND NOT b3
  UNION ALL SELECT conv_id, '$.required_users', 'must have at least 2 entries', NULL FROM f WHERE b5
  UNION ALL SELECT conv_id, '$.required_users', 'entries must differ', NULL FROM f WHERE b6 AND NOT b5
  UNION ALL SELECT conv_id, '$.single_user_answerability.u1', 'must be marked insufficient', NULL FROM f, range(CASE WHEN b6 AND NOT b5 THEN 2 ELSE 1 END) WHERE b7
  UNION ALL SELECT conv_id, '$.combined_answerability', 'must state sufficient support', 'unclear' FROM f WHERE b8
  UNION ALL SELECT conv_id, '$.question_type', 'must be commonality or difference', 'mix' FROM f WHERE b9
  UNION ALL SELECT conv_id, '$.review', 'must be an object', NULL FROM f WHERE b13)
"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    return convs.selectExpr("conv_id", *_faults("conv_id", 14).split(", ")).selectExpr("conv_id", f"{_ITEM} AS item")


@query("validate_items", _PLAIN_SQL + "SELECT * FROM p")
def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of multiple-choice items, with the place of each."""
    return va.validate(_items(spark, sf_dir), "conv_id", "item", va.choice_item())


@query("validate_items_strict", _PLAIN_SQL + """
SELECT * FROM p
UNION ALL SELECT conv_id, '$', 'missing strict fields', 'human_audit' FROM f WHERE b10
UNION ALL SELECT conv_id, '$.human_audit', 'must be an object', NULL FROM f WHERE b10
UNION ALL SELECT conv_id, '$.review.judger.gate.passed', 'must be true', 'false' FROM f WHERE b11 AND NOT b13
UNION ALL SELECT conv_id, '$.review.judger.checks.gaze_safety', 'status must be PASS', NULL FROM f WHERE b12 AND NOT b13""")
def validate_items_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items with the gates of the review, four levels deep."""
    return va.validate(_items(spark, sf_dir), "conv_id", "item", va.choice_item(), strict=True)


_QUESTION = """to_json(named_struct('id', if(b0, 'q1', '2026_q1'), 'query', if(b1, '  ', 'who?'), 'note', if(b4, 'n', null),
  'answers', named_struct('a', '1', 'b', '2', 'c', '3', 'd', if(b2, null, '4'), 'e', if(b3, '5', null))))"""


@query("validate_questions", f"""
WITH f AS (SELECT doc_id, {_faults('doc_id', 7)} FROM documents)
SELECT doc_id, '$' AS path, 'is no JSON' AS rule, NULL AS value FROM f WHERE b6
UNION ALL SELECT doc_id, '$', 'unknown fields', 'note' FROM f WHERE b4 AND NOT b6
UNION ALL SELECT doc_id, '$.id', 'must begin with 2026_q', 'q1' FROM f WHERE b0 AND NOT b6
UNION ALL SELECT doc_id, '$.query', 'must be a text', '  ' FROM f WHERE b1 AND NOT b6
UNION ALL SELECT doc_id, '$.answers', 'must be an object', NULL FROM f WHERE b5 AND NOT b6
UNION ALL SELECT doc_id, '$.answers', 'missing fields', 'd' FROM f WHERE b2 AND NOT b5 AND NOT b6
UNION ALL SELECT doc_id, '$.answers', 'unknown fields', 'e' FROM f WHERE b3 AND NOT b5 AND NOT b6""")
def validate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a question file: exact fields, ids by their beginning, answers a to d."""
    rows = load(spark, sf_dir, "documents").selectExpr("doc_id", *_faults("doc_id", 7).split(", ")).withColumn("q", F.expr(_QUESTION))
    listed = F.when(F.col("b5"), F.regexp_replace("q", r'"answers":\{[^}]*\}', '"answers":["1"]')).otherwise(F.col("q"))
    broken = F.when(F.col("b6"), F.substring(listed, 1, 9)).otherwise(listed)
    return va.validate(rows.select("doc_id", broken.alias("q")), "doc_id", "q", va.question_entry())
