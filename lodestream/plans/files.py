"""Readers and writers of text files: each query writes rows of a table in some format to a new folder of the
shared one, and returns what a reader makes of it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, writers
from ..sources.lines import read_lines, read_lines_strict
from ..sources.tables import load, shared_folder
from .registry import query

#: Rows of a file, so that no file grows with the table.
SEGMENT = 1_000


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lodestream-files/{uuid.uuid4().hex}"


def _event_lines(spark: SparkSession, sf_dir: str, folder: str, broken: bool) -> None:
    """Events as JSON lines, a file for each stretch of ids, in order; some lines blank and, if asked for, some bad."""
    events = load(spark, sf_dir, "events").withColumn("segment", F.lpad(F.floor(F.col("event_id") / SEGMENT).cast("string"), 9, "0"))
    good = F.to_json(F.struct("event_id", "user_id", "event_type"))
    n = F.col("event_id")
    bad = (
        F.when(n % 97 == 5, F.expr("substr(good, 1, length(good) - 3)"))
        .when(n % 101 == 7, F.concat(F.lit("["), "good", F.lit("]")))
        .when(n % 103 == 9, F.replace("good", F.lit('"user_id":'), F.lit('"user_id":"none","was":')))
        .when(n % 107 == 11, F.concat("good", F.lit(" {}")))
    )
    line = F.when(n % 50 == 3, "  ").otherwise(F.coalesce(bad, "good") if broken else F.col("good"))
    lines = events.withColumn("good", good).select("segment", "event_id", line.alias("value"))
    ordered = lines.repartition("segment").sortWithinPartitions("segment", "event_id").select("segment", "value")
    ordered.write.partitionBy("segment").text(folder)


_LINES_SQL = """
WITH e AS (SELECT event_id, user_id, event_type, (event_id // 1000)::BIGINT AS segment,
  row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS line FROM events),
r AS (SELECT *, CASE WHEN event_id % 50 = 3 THEN 'blank' WHEN event_id % 97 = 5 THEN 'invalid JSON row' WHEN event_id % 101 = 7 THEN 'expected JSON object'
  WHEN event_id % 103 = 9 THEN 'a field doesn''t fit its type' WHEN event_id % 107 = 11 THEN 'invalid JSON row' END AS reason FROM e)
"""
_FIELDS = "event_id long, user_id long, event_type string"


@query("jsonl_quarantine", _LINES_SQL + "SELECT segment, line, reason FROM r WHERE reason <> 'blank'")
def jsonl_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad lines with their file, number and reason."""
    folder = _new_folder(spark)
    _event_lines(spark, sf_dir, folder, broken=True)
    bad = read_lines(spark, folder, _FIELDS).quarantine
    return bad.select(F.regexp_extract("path", r"segment=(\d+)", 1).cast("long").alias("segment"), "line", "reason")


@query("jsonl_lenient", _LINES_SQL + "SELECT event_id, user_id, event_type FROM r WHERE reason IS NULL")
def jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good lines of files with bad ones."""
    folder = _new_folder(spark)
    _event_lines(spark, sf_dir, folder, broken=True)
    return read_lines(spark, folder, _FIELDS).rows


@query("jsonl_strict", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 50 <> 3")
def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of files without bad ones; a bad one would be an error with its path and number."""
    folder = _new_folder(spark)
    _event_lines(spark, sf_dir, folder, broken=False)
    return read_lines_strict(spark, folder, _FIELDS)


@query("jsonl_sink", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def jsonl_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written in two steps, the second appended, and read again."""
    folder, turns = _new_folder(spark), load(spark, sf_dir, "conversations")
    writers.write_jsonl(turns.filter("turn = 0"), folder)
    writers.write_jsonl(turns.filter("turn IS NULL OR turn <> 0"), folder, append=True)
    rows = readers.read_jsonl(spark, folder, "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("json_documents", "SELECT event_id, user_id, value, event_type FROM events")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole JSON documents, each an array over several lines with an object for each row of a stretch of ids."""
    folder = _new_folder(spark)
    events = load(spark, sf_dir, "events").select(F.floor(F.col("event_id") / SEGMENT).alias("segment"), F.struct("event_id", "user_id", "value", "event_type").alias("row"))
    document = events.groupBy("segment").agg(F.to_json(F.collect_list("row")).alias("value"))  # at most SEGMENT rows each
    spread = document.select("segment", F.replace("value", F.lit("},{"), F.lit("},\n  {")).alias("value"))
    spread.write.partitionBy("segment").text(folder)
    return readers.read_json(spark, folder, "event_id long, user_id long, value double, event_type string").drop("segment")


@query("csv_sink", r"""
SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, md5(replace(text, chr(10), '\n')) AS text_md5, true AS no_note FROM conversations""")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed columns as CSV, one of them missing, and read again as text; quotes and commas come back, line breaks are written out."""
    folder = _new_folder(spark)
    columns = ["conv_id", "turn", "role", "text", "note"]
    writers.write_csv(load(spark, sf_dir, "conversations"), folder, columns)
    rows = readers.read_csv(spark, folder, columns)
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), F.col("note").isNull().alias("no_note"))


@query("tsv_scan", r"""
SELECT doc_id::VARCHAR AS id, md5(trim(regexp_replace(substr(text, 1, 200), '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ')) AS text_md5 FROM documents""")
def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) read from tab-separated files with a header."""
    folder = _new_folder(spark)
    start = F.btrim(F.regexp_replace(F.substring("text", 1, 200), r"[ \t\n\r\f\x0b]+", " "))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), start.alias("text"))
    rows.write.option("header", True).option("sep", "\t").option("escape", '"').csv(folder)
    return readers.read_tsv(spark, folder).select("id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


@query("json_map_merge", "SELECT user_id::VARCHAR AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def json_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory of JSON objects merged to one map: for every user the type of the last event, later files overriding."""
    folder = _new_folder(spark)
    segment = F.lpad(F.floor(F.col("event_id") / SEGMENT).cast("string"), 9, "0")
    last = load(spark, sf_dir, "events").groupBy(segment.alias("segment"), F.col("user_id").cast("string").alias("k")).agg(F.max_by("event_type", "event_id").alias("v"))
    maps = last.groupBy("segment").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value"))  # at most SEGMENT users each
    maps.write.partitionBy("segment").text(folder)
    return readers.read_json_maps(spark, folder)


@query("point_lookup", "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents WHERE doc_id = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only document with an id; none or two would be an error."""
    return readers.one_row(load(spark, sf_dir, "documents"), F.col("doc_id") == 7).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("list_file", "SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id % 10 <> 4 AND doc_id % 7 <> 2")
def list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of a list's lines; comments and blank lines don't count."""
    folder, n = _new_folder(spark), F.col("doc_id")
    line = F.when(n % 10 == 4, F.concat(F.lit("  # "), n.cast("string"))).when(n % 7 == 2, "   ").otherwise(F.concat(F.lit(" "), n.cast("string"), F.lit("\t"), "source"))
    load(spark, sf_dir, "documents").select(line.alias("value")).write.text(folder)
    return readers.read_list(spark, folder)


@query("media_index", r"""
WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') AS path FROM pages),
b AS (SELECT path, lower(string_split(path, '/')[-1]) AS name FROM p WHERE path NOT LIKE '%/fr/%')
SELECT name, CASE WHEN name LIKE '%.html' THEN 'page' WHEN name LIKE '%.mp4' THEN 'video' END AS kind, count(*) AS n, min(path) AS first_path
FROM b WHERE name LIKE '%.html' OR name LIKE '%.mp4' GROUP BY 1, 2""")
def media_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by lower-case base name and kind of extension, a row for each path; one directory is left out."""
    paths = load(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path"))
    found = readers.media_rows(paths, {"page": ["html"], "video": ["mp4"]}, skip=["fr"])
    return found.groupBy("name", "kind").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query("summary_tree", """
SELECT event_type || '_' || (user_id % 3) AS agent_group, 2 AS agent_count, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type, user_id % 3""")
def summary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary documents in a tree of directories, found by a path pattern."""
    folder = _new_folder(spark)
    events = load(spark, sf_dir, "events").withColumn("g", F.concat_ws("_", "event_type", (F.col("user_id") % 3).cast("string")))
    events.groupBy("g").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).write.partitionBy("g").json(folder)
    rows = readers.read_summaries(spark, f"{folder}/*/*.json", "n long, mean double")
    group = F.regexp_replace("agent_group", "^g=", "")
    return rows.select(group.alias("agent_group"), "agent_count", "n", F.round("mean", 6).alias("mean"))


@query("markdown_report", """
WITH c AS (SELECT coalesce(lang, '') AS lang, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, lang) AS k FROM c)
SELECT 1 AS line, '| lang | n |' AS text UNION ALL SELECT 2, '|---|---|' UNION ALL SELECT (k + 2)::INTEGER, '| ' || lang || ' | ' || n || ' |' FROM o WHERE k <= 100""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of at most a hundred lines for people: documents by language as a Markdown table."""
    counts = load(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"))
    text = writers.markdown_table(counts.orderBy(F.desc("n"), "lang"))
    return spark.createDataFrame([(i, t) for i, t in enumerate(text.split("\n"), 1)], "line int, text string")
