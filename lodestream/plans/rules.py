"""Rule tables over texts and keys: hints, kinds, routes, failures, evidence lines, rebuilt keys.

The tables' prose is invented, so texts are put together from events; words and labels are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import timefns as tm
from ..functions.decisions import decision_list
from ..sources.tables import events_as_intervals, load
from .registry import query


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _by(number: Column, *forms: str | Column) -> Column:
    """The form whose place is the number modulo how many there are."""
    return F.coalesce(*[F.when(number % len(forms) == i, F.lit(f) if isinstance(f, str) else f) for i, f in enumerate(forms)])


def _forms_sql(*forms: str) -> str:
    return f"CASE event_id % {len(forms)} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


_ASKED = (
    ("'How many cups were on the ' || event_type || ' table?'", ("How many cups were on the ", " table?")),
    ("'Who used the ' || event_type || ' the most on Day 2?'", ("Who used the ", " the most on Day 2?")),
    ("'Where was the red ' || event_type || ' in the kitchen in the morning?'", ("Where was the red ", " in the kitchen in the morning?")),
    ("'What did they want from the ' || event_type || ' after 10 am, on the sofa?'", ("What did they want from the ", " after 10 am, on the sofa?")),
    ("'Which brand of ' || event_type || ' stood by the oven that evening of the third day?'", ("Which brand of ", " stood by the oven that evening of the third day?")),
    ("'Someone asked: ' || event_type || ', was it the FIRST time?'", ("Someone asked: ", ", was it the FIRST time?")),
    ("'nothing about the ' || event_type", ("nothing about the ", "")),
)
_ASKED_SQL = "WITH q AS (SELECT event_id, event_type, " + _forms_sql(*[sql for sql, _ in _ASKED]) + " AS text FROM events)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _by(F.col("event_id"), *[_text(a, F.col("event_type"), b) for _, (a, b) in _ASKED])
    return load(spark, sf_dir, "events").select("event_id", "event_type", text.alias("text"))


def _any_sql(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


def _pattern_sql(patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in patterns) + ")"


@query("broad_question_flags", _ASKED_SQL + f" SELECT event_id, {_pattern_sql(rules.BROAD_PATTERNS)} AS broad, {_pattern_sql(rules.EXHAUSTIVE_PATTERNS)} AS exhaustive FROM q")
def broad_question_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about more than one passage, and those that need every single case."""
    text = F.col("text")
    return _asked(spark, sf_dir).select(
        "event_id", rules.matches_any(text, rules.BROAD_PATTERNS).alias("broad"), rules.matches_any(text, rules.EXHAUSTIVE_PATTERNS).alias("exhaustive")
    )


_DAYS = {"day1": ("day 1", "first day"), "day2": ("day 2", "second day"), "day3": ("day 3", "third day")}
_TIMES = {"morning": ("morning",), "evening": ("evening",)}
_ROOMS = ((("kitchen", "oven"), ("Kitchen",)), (("sofa", "couch"), ("Living1", "Living2")), (("table", "sofa"), ("Meeting", "Living1")))


def _first_sql(found: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join(f"WHEN {_any_sql(words)} THEN '{label}'" for label, words in found.items()) + " END"


@query("place_time_hints", _ASKED_SQL + f"""
, h AS (SELECT event_id, {_first_sql(_DAYS)} AS day, {_first_sql(_TIMES)} AS part, CASE WHEN {_any_sql(_ROOMS[0][0])} THEN ['Kitchen'] ELSE [] END AS a,
  CASE WHEN {_any_sql(_ROOMS[1][0])} THEN ['Living1', 'Living2'] ELSE [] END AS b, CASE WHEN {_any_sql(_ROOMS[2][0])} THEN ['Meeting', 'Living1'] ELSE [] END AS c FROM q)
SELECT event_id, day, coalesce(nullif(concat_ws('; ', upper(day), part), ''), 'unknown') AS "window",
  array_to_string(list_concat(a, b, list_filter(c, lambda x: NOT list_contains(list_concat(a, b), x))), ';') AS cameras FROM h""")
def place_time_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day, time and cameras that a question hints at, each by ordered rules."""
    text = F.col("text")
    day, part = rules.first_label(text, _DAYS), rules.first_label(text, _TIMES)
    window = F.coalesce(F.nullif(F.concat_ws("; ", F.upper(day), part), F.lit("")), F.lit("unknown"))
    cameras = F.array_join(rules.all_labels(text, _ROOMS), ";")
    return _asked(spark, sf_dir).select("event_id", day.alias("day"), window.alias("window"), cameras.alias("cameras"))


_PREFIXES = {"how many": "count", "who": "person", "where": "place"}
_DETAILS = {"detail": ("brand", "color")}


@query("question_kind", _ASKED_SQL + f"""
SELECT event_id, CASE WHEN starts_with(lower(text), 'how many') THEN 'count' WHEN starts_with(lower(text), 'who') THEN 'person' WHEN starts_with(lower(text), 'where') THEN 'place'
  WHEN {_any_sql(_DETAILS['detail'])} THEN 'detail' WHEN event_type = 'view' THEN 'speech' ELSE event_type END AS kind FROM q""")
def question_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question asks for: by its first words, by words in it, else by its category."""
    category = F.when(F.col("event_type") == "view", "speech").otherwise(F.col("event_type"))
    return _asked(spark, sf_dir).select("event_id", rules.question_kind(F.col("text"), _PREFIXES, _DETAILS, category).alias("kind"))


#: label: (words, routes); a question takes the routes of all its labels, in order.
_TAXONOMY = {
    "speech": (("asked", "want"), ("audio", "caption")),
    "count": (("how many", "number of"), ("frame", "caption")),
    "place": (("where", "kitchen", "sofa"), ("room camera", "frame")),
    "sequence": (("first time", "the most"), ("caption", "memory")),
    "detail": (("brand", "red"), ("frame", "zoom")),
}
_TAX_FLAGS_SQL = ", ".join(f"{_any_sql(words)} AS {label}" for label, (words, _) in _TAXONOMY.items())
_TAX_ROUTES_SQL = "list_concat(" + ", ".join(f"CASE WHEN {label} THEN {list(routes)} ELSE [] END" for label, (_, routes) in _TAXONOMY.items()) + ")"


@query("taxonomy_routes", _ASKED_SQL + f"""
, f AS (SELECT event_id, {_TAX_FLAGS_SQL} FROM q),
r AS (SELECT event_id, concat_ws(';', {', '.join(f"CASE WHEN {x} THEN '{x}' END" for x in _TAXONOMY)}) AS labels, {_TAX_ROUTES_SQL} AS routes FROM f)
SELECT event_id, labels, coalesce(routes[1], 'caption') AS primary_route, coalesce(nullif(array_to_string(list_filter(routes, lambda x, i: list_position(routes, x) = i), ';'), ''), 'caption') AS routes FROM r""")
def taxonomy_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels of a question, the first route to its evidence, and all routes in order, each once."""
    text = F.col("text")
    labels = rules.all_labels(text, [(words, (label,)) for label, (words, _) in _TAXONOMY.items()])
    routes = rules.all_labels(text, [(words, own) for words, own in _TAXONOMY.values()])
    found = _asked(spark, sf_dir).select("event_id", F.array_join(labels, ";").alias("labels"), routes.alias("r"))
    some = F.when(F.size("r") > 0, F.col("r")).otherwise(F.array(F.lit("caption")))
    return found.select("event_id", "labels", F.get(some, F.lit(0)).alias("primary_route"), F.array_join(some, ";").alias("routes"))


_LOGS = (
    "'HTTP error 403 for ' || event_type", "'Server says: partial content, ' || event_type", "'moov atom not found in ' || event_type", "'nothing known of ' || event_type",
)


@query("failure_kind", f"""
WITH l AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'tool_missing' WHEN 1 THEN 'tool_timeout' WHEN 2 THEN 'local_storage_limit_reached' WHEN 3 THEN 'done' ELSE 'tool_failed' END AS stopped, {_forms_sql(*_LOGS)} AS log FROM events)
SELECT event_id, CASE WHEN stopped = 'tool_missing' THEN 'not installed' WHEN stopped = 'tool_timeout' THEN 'timeout' WHEN contains(stopped, 'storage_limit') THEN 'too much written'
  WHEN stopped <> 'tool_failed' THEN 'none' WHEN regexp_matches(lower(log), '401|403|authorization') THEN 'authentication' WHEN regexp_matches(lower(log), 'range|seek|partial') THEN 'seeking'
  WHEN regexp_matches(lower(log), 'moov atom|invalid data') THEN 'format' ELSE 'other' END AS failure FROM l""")
def failure_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a run stopped: by its status, then by words of its log."""
    i, kind = F.col("event_id"), F.col("event_type")
    k = i % 9
    stopped = F.when(k == 0, "tool_missing").when(k == 1, "tool_timeout").when(k == 2, "local_storage_limit_reached").when(k == 3, "done").otherwise("tool_failed")
    log = _by(i, _text("HTTP error 403 for ", kind), _text("Server says: partial content, ", kind), _text("moov atom not found in ", kind), _text("nothing known of ", kind))
    rows = load(spark, sf_dir, "events").select("event_id", stopped.alias("stopped"), log.alias("log"))
    words = {"authentication": ("401", "403", "authorization"), "seeking": ("range", "seek", "partial"), "format": ("moov atom", "invalid data")}
    of_log = F.coalesce(rules.first_label(F.col("log"), words), F.lit("other"))
    s = F.col("stopped")
    by_status = decision_list([(s == "tool_missing", "not installed"), (s == "tool_timeout", "timeout"), (s.contains("storage_limit"), "too much written"), (s != "tool_failed", "none")])
    return rows.select("event_id", F.coalesce(by_status, of_log).alias("failure"))


_CLOCKED = """
WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 86400000000 - 19722 AS day, epoch_us(ts) // 1000 % 86400000 // 10 * 10 AS sod FROM events),
t AS (SELECT *, lpad((sod // 3600000)::VARCHAR, 2, '0') AS h, lpad((sod // 60000 % 60)::VARCHAR, 2, '0') AS m, lpad((sod // 1000 % 60)::VARCHAR, 2, '0') AS s, lpad((sod // 10 % 100)::VARCHAR, 2, '0') AS c FROM e)
"""


def _clocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a clock text to the hundredth and the token of the same time."""
    e = events_as_intervals(spark, sf_dir).withColumn("day", F.col("day") - 19722).withColumn("sod", F.floor(F.col("sod_ms") / 10) * 10)
    return e.withColumn("clock", F.substring(tm.millis_clock("sod"), 1, 11)).withColumn("token", F.translate("clock", ":.", ""))


@query("evidence_lines", _CLOCKED + """
, l AS (SELECT event_id, unnest([1, 2, 3]) AS n, event_type, day, h || ':' || m || ':' || s || '.' || c AS clock, event_id % 50 AS score FROM t)
SELECT event_id, n::INTEGER AS rank, CASE n WHEN 1 THEN score + 0.5 WHEN 2 THEN -1.0 ELSE score * 1.0 END::DOUBLE AS score, CASE n WHEN 2 THEN 'Bob' ELSE 'ann' END AS source, day::INTEGER AS day, clock AS start,
  CASE n WHEN 1 THEN event_type || ' begins, goes on [not a head] and ends' ELSE 'line ' || n END AS caption
FROM l WHERE n <> CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END""")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence written as text, captions over several lines, parsed; lines of another scope are left out."""
    e = _clocked(spark, sf_dir)
    score, one, other = F.col("event_id") % 50, F.lit("current_only"), F.lit("history_only")
    place = _text(" D", F.col("day"), " ", F.col("clock"), "-", F.col("clock"), " 30sec] ")
    third = F.col("event_id") % 3 == 0
    text = _text(
        "preface\n[", one, " rank=1 score=", score, ".5 source=ann", place, F.col("event_type"), " begins,\n  goes on\n[not a head] and\tends\n[",
        F.when(third, one).otherwise(other), " rank=2 score=-1.0 source=Bob", place, "line 2\n[", F.when(third, other).otherwise(one), " rank=3 score=", score, " source=ann", place, "line 3",
    )
    parsed = e.select("event_id", text.alias("text")).select("event_id", F.explode(rules.evidence_lines(F.col("text"))).alias("l"))
    return parsed.filter("l.scope = 'current_only'").select("event_id", "l.rank", "l.score", "l.source", "l.day", "l.start", "l.caption")


@query("raw_key_rebuild", _CLOCKED + """
, r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'A1_ANN' WHEN 'view' THEN 'A2_BOB' WHEN 'error' THEN 'A3_CLEO' END AS folder, CASE WHEN event_id % 7 = 0 THEN '' ELSE day::VARCHAR END AS day,
  CASE WHEN event_id % 3 = 0 THEN 'DAY9_X_' || event_id || '.mp4' ELSE '' END AS given, CASE WHEN event_id % 5 <> 0 THEN h || m || s || c END AS token FROM t),
k AS (SELECT *, CASE WHEN given <> '' THEN given ELSE coalesce('DAY' || day || '_' || folder || '_' || token || '.mp4', '') END AS key FROM r)
SELECT event_id, key, CASE WHEN folder IS NOT NULL AND day <> '' AND key <> '' THEN folder || '/DAY' || day || '/' || key ELSE '' END AS path,
  concat_ws('; ', CASE WHEN folder IS NULL THEN 'unknown source' END, CASE WHEN day = '' THEN 'missing day' END, CASE WHEN given = '' AND key <> '' THEN 'key rebuilt from source, day and start' END,
    CASE WHEN key = '' THEN 'no key and too little to rebuild it' END, CASE WHEN folder IS NOT NULL AND day <> '' AND given <> '' THEN 'resolved from the key' END) AS reason FROM k""")
def raw_key_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of clips whose key may be missing, with what is wrong."""
    i = F.col("event_id")
    rows = _clocked(spark, sf_dir).select(
        "event_id", "event_type", F.when(i % 7 == 0, "").otherwise(F.col("day").cast("string")).alias("day"),
        F.when(i % 3 == 0, _text(" DAY9_X_", i, ".mp4 ")).otherwise("").alias("key"), F.when(i % 5 == 0, "").otherwise(F.col("clock")).alias("start"),
    )
    folders = {"click": "A1_ANN", "view": "A2_BOB", "error": "A3_CLEO"}
    found = rows.select("event_id", rules.resolve_clip(F.col("event_type"), F.col("day"), F.col("key"), F.col("start"), folders).alias("c"))
    return found.select("event_id", "c.key", "c.path", "c.reason")


@query("frame_offset", _CLOCKED + """
SELECT event_id, least(greatest(0, event_id % 45 * 1000 - 5000 + CASE WHEN event_id % 4 = 0 THEN 2000 ELSE 0 END), CASE event_id % 3 WHEN 0 THEN 29500 WHEN 1 THEN 0 ELSE 100000000 END)::BIGINT AS offset_ms FROM t""")
def frame_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets as offsets into their clips; every fourth key tells no start, and the row's own lies two seconds earlier."""
    i = F.col("event_id")
    key = F.when(i % 4 == 0, "clip.mp4").otherwise(_text("DAY1_A1_ANN_", F.col("token"), ".mp4"))
    duration = F.when(i % 3 == 0, 30_000).when(i % 3 == 1, 400)
    rows = _clocked(spark, sf_dir).select("event_id", "sod", key.alias("key"), duration.cast("long").alias("duration"))
    offset = rules.frame_offset(F.col("sod") + i % 45 * 1000 - 5000, F.col("key"), F.col("sod") - 2000, F.col("duration"))
    return rows.select("event_id", offset.alias("offset_ms"))


@query("metadata_complete", """
WITH d AS (SELECT event_id, event_type, user_id, event_id % 6 AS k FROM events)
SELECT event_id, CASE WHEN k = 1 THEN 'general' ELSE event_type END AS category, CASE k WHEN 2 THEN 'Z' WHEN 3 THEN NULL ELSE 'C' END AS correct,
  CASE k WHEN 2 THEN 'as given' WHEN 3 THEN 'none' WHEN 4 THEN 'as given' ELSE 'third ' || user_id END AS answer FROM d""")
def metadata_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions' JSON completed: defaults, and the answer by the letter of the correct option."""
    k = F.col("event_id") % 6
    options = _text('["first", "second", "third ', F.col("user_id"), '", "fourth"]')
    doc = _text(
        "{", F.when(k == 1, "").otherwise(_text('"category": "', F.col("event_type"), '", ')),
        F.when(k == 2, '"correct": "Z", ').when(k == 3, "").otherwise('"correct": " c ", '),
        F.when(k == 3, "").otherwise('"answer": "as given", '), '"options": ', F.when(k == 4, '["only", "two"]').otherwise(options), "}",
    )
    rows = load(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return rows.select("event_id", rules.completed(F.col("doc"), {"category": "general", "answer": "none"}).alias("c")).select("event_id", "c.*")
