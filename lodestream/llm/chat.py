"""Operator 6, chat formatting: multi-party perspective rotation (native).

Every participant of a conversation gets a rendering of the whole dialogue in which that speaker is
the assistant and all other participants are named users. The loss mask covers what the assistant
says, its end mark included, and nothing else. Context roles (``system``) are rendered as context in
every perspective and have no perspective of their own.

A turn is rendered as ``<|assistant|>\\n{text}<|end|>\\n``, ``<|user {name}|>\\n...`` or
``<|system|>\\n...``. A ``<|`` inside a text or a name is written ``<\\|``, so that content cannot
forge a mark.

Scale: turns are grouped into blocks of ``block_turns`` turns before anything is concatenated, so a
conversation of any length never meets in one row; offsets in ``mask`` are code points within the
block's text. Conversations of fewer turns, the usual case, are one block.

Defined results for odd input: turns are in order of (turn, speaker, text), a null turn first in a
block of its own; a null role is the participant ``unknown``; a null text is empty; repeated rows
are rendered as often as they occur; a null conv_id is one conversation; a conversation of context
turns only has no perspective and no row; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

CONTEXT_ROLES = ("system",)
BLOCK_TURNS = 256
END = "<|end|>\n"


def _safe(col: Column) -> Column:
    return F.replace(col, F.lit("<|"), F.lit("<\\|"))


def _turn_blocks(turns: DataFrame, block_turns: int) -> DataFrame:
    """(conv_id, block, sub, turns): at most ``block_turns`` turns a row, in order."""
    plain = turns.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    ).withColumn("block", F.floor(F.col("turn") / block_turns))
    order = Window.partitionBy("conv_id", "block").orderBy("turn", "speaker", "body")
    placed = plain.withColumn("place", F.row_number().over(order)).withColumn(
        "sub", F.floor((F.col("place") - 1) / block_turns).cast("int")
    )
    return placed.groupBy("conv_id", "block", "sub").agg(
        F.sort_array(F.collect_list(F.struct("place", "speaker", "body"))).alias("turns"),
        F.min("turn").alias("first_turn"),
    )


def rotate_perspectives(
    turns: DataFrame, context_roles: Sequence[str] = CONTEXT_ROLES, block_turns: int = BLOCK_TURNS
) -> DataFrame:
    """(conv_id, perspective, block, sub, first_turn, n_turns, text, mask) of every participant.

    ``mask`` is an array of (start, end) spans, in code points of ``text``, that carry loss.
    """
    context = [F.lit(r) for r in context_roles]
    speaker = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    people = turns.select(F.col("conv_id").alias("__ls_conv"), speaker.alias("perspective")).distinct()
    if context:
        people = people.filter(~F.col("perspective").isin(*context_roles))
    blocks = _turn_blocks(turns, block_turns)
    joined = blocks.join(people, F.col("conv_id").eqNullSafe(F.col("__ls_conv"))).drop("__ls_conv")

    def piece(t: Column) -> Column:
        is_context = t["speaker"].isin(*context_roles) if context else F.lit(False)
        head = (
            F.when(is_context, F.concat(F.lit("<|"), _safe(t["speaker"]), F.lit("|>\n")))
            .when(t["speaker"] == F.col("perspective"), F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit("<|user "), _safe(t["speaker"]), F.lit("|>\n")))
        )
        return F.struct(
            head.alias("head"),
            F.concat(_safe(t["body"]), F.lit(END)).alias("said"),
            (t["speaker"] == F.col("perspective")).alias("loss"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def advance(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["head"])
        end = begin + F.char_length(p["said"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    pieces = joined.withColumn("pieces", F.transform("turns", piece))
    return pieces.select(
        "conv_id", "perspective",
        F.coalesce(F.col("block"), F.lit(-1)).cast("long").alias("block"), "sub", "first_turn",
        F.size("turns").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["said"])), "").alias("text"),
        F.aggregate("pieces", start, advance)["spans"].alias("mask"),
    )


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every perspective of every conversation, with digests of text and mask."""
    rendered = rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return rendered.select(
        "conv_id", "perspective", "block", "sub", "n_turns",
        F.char_length("text").cast("long").alias("n_chars"),
        F.aggregate("mask", F.lit(0), lambda a, s: a + s["end"] - s["start"]).cast("long").alias("n_loss_chars"),
        F.md5("text").alias("text_md5"),
        F.array_join(spans, ",").alias("mask_spans"),
    )


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body, floor(turn / 256)::BIGINT AS block FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.*, perspective,
    row_number() OVER (PARTITION BY t.conv_id, block, perspective ORDER BY turn, speaker, body) AS place,
    CASE WHEN speaker = 'system' THEN '<|system|>' WHEN speaker = perspective THEN '<|assistant|>'
      ELSE '<|user ' || replace(speaker, '<|', '<\|') || '|>' END || chr(10) AS head,
    replace(body, '<|', '<\|') || '<|end|>' || chr(10) AS said
  FROM t JOIN p USING (conv_id)),
o AS (
  SELECT *, (place - 1) // 256 AS sub,
    sum(length(head) + length(said)) OVER (PARTITION BY conv_id, block, perspective, (place - 1) // 256 ORDER BY place) - length(said) AS begin_at
  FROM r)
SELECT conv_id, perspective, coalesce(block, -1) AS block, sub::INTEGER AS sub, count(*)::INTEGER AS n_turns,
  sum(length(head) + length(said))::BIGINT AS n_chars,
  coalesce(sum(length(said)) FILTER (WHERE speaker = perspective), 0)::BIGINT AS n_loss_chars,
  md5(string_agg(head || said, '' ORDER BY place)) AS text_md5,
  coalesce(string_agg(begin_at::BIGINT || '-' || (begin_at + length(said))::BIGINT, ',' ORDER BY place) FILTER (WHERE speaker = perspective), '') AS mask_spans
FROM o GROUP BY conv_id, perspective, block, sub
"""
