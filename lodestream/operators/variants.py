"""JSON of any depth without a schema: VARIANT values, exploded level by level until no container is left.

Every level is one pass of built-in functions over the containers of the level above, written in between, so
there is no bound on depth and no Python. Fields that hold for all below them are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

# Names of the fields that hold texts, speakers and times in the input.
TEXT_KEYS = ("text", "transcript", "utterance", "caption", "sentence")
SPEAKER_KEYS = ("speaker", "speaker_id", "name", "agent", "participant")
STAMP_KEYS = ("timestamp", "time", "start", "start_time", "end", "end_time", "window")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _field(node: Column, names: tuple[str, ...], fractions: bool) -> Column:
    """The first of some fields that is a text or a number, as text."""
    kinds = "^(STRING|BOOLEAN|BIGINT" + ("|DOUBLE|FLOAT|DECIMAL.*)$" if fractions else "|DECIMAL\\(\\d+,0\\))$")
    found = []
    for name in names:
        value = F.try_variant_get(node, f"$.{name}", "variant")
        found.append(F.when(_kind(value).rlike(kinds), F.try_variant_get(node, f"$.{name}", "string")))
    return F.coalesce(*found)


def flatten_json(rows: DataFrame, id_col: str, json_col: str, longer_than: int = 10) -> DataFrame:
    """(id, n, speaker, stamp, text): text-like strings of JSON of any depth, in order.

    The nearest speaker and the outermost timestamp hold for everything below them. A value under a text key is
    given out once; other strings if they are longer than ``longer_than``. Elements of an array go by position and
    keep its key, fields of an object by name. Broken JSON gives no row.
    """
    spark = rows.sparkSession
    none = F.lit(None).cast("string")
    level = rows.select(
        F.col(id_col).alias("id"), F.try_parse_json(F.col(json_col).cast("string")).alias("node"), F.array().cast("array<int>").alias("path"),
        none.alias("key"), none.alias("speaker"), none.alias("stamp"),
    )
    kind = _kind(F.col("node"))
    level = level.filter(F.col("node").isNotNull()).withColumn("kind", kind)
    string = F.when(F.col("kind") == "STRING", F.try_variant_get("node", "$", "string"))
    wanted = F.col("key").isin(*TEXT_KEYS) | (F.char_length(string) > longer_than)
    open_ = "kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'"
    level = checkpointed(level.withColumn("text", F.when(wanted, string)))
    found = []
    while True:
        found.append(level.filter("text IS NOT NULL").select("id", "path", "speaker", "stamp", "text"))
        level = level.filter(open_).drop("text")
        if level.isEmpty():
            break
        is_object = F.col("kind").startswith("OBJECT")
        node = F.col("node")
        inherited = level.select(
            "id", "node", "path", "key", is_object.alias("in_object"),
            F.when(is_object, F.coalesce(_field(node, SPEAKER_KEYS, False), "speaker")).otherwise(F.col("speaker")).alias("speaker"),
            F.when(is_object, F.coalesce("stamp", _field(node, STAMP_KEYS, True))).otherwise(F.col("stamp")).alias("stamp"),
        ).alias("l")
        children = inherited.lateralJoin(spark.tvf.variant_explode(F.col("l.node").outer()).alias("c")).select(
            "l.id", F.concat("l.path", F.array("c.pos")).alias("path"), F.when(F.col("l.in_object"), F.col("c.key")).otherwise(F.col("l.key")).alias("key"),
            F.col("c.value").alias("node"), "l.speaker", "l.stamp", "l.in_object",
        )
        ours = ~(F.col("in_object") & F.col("key").isin(*SPEAKER_KEYS, *STAMP_KEYS))
        typed = children.filter(F.col("node").isNotNull() & ours).drop("in_object").withColumn("kind", kind)
        level = checkpointed(typed.withColumn("text", F.when(wanted, string)))
    everything = found[0]
    for more in found[1:]:
        everything = everything.union(more)
    number = F.row_number().over(Window.partitionBy("id").orderBy("path")) - 1  # the strings of one document
    return everything.select(F.col("id").alias(id_col), number.cast("long").alias("n"), "speaker", "stamp", "text")
