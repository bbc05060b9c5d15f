"""Keys, paths, contexts and JSON text taken apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import timefns as tm

# Formats of the input that keys, paths and lines have to match.
CLIP_PATH = r"^A(\d+)_([A-Z]+)/DAY(\d+)/DAY(\d+)_A(\d+)_([A-Z]+)_(\d{8})\.mp4$"
CONTEXT_KEY = r"^DAY(\d+)_(\d{6,8})_(\d{6,8})$"
CLIP_KEY = r"^DAY(\d+)_A\d+_[A-Z]+_(\d{6,8})\.mp4$"
SPAN_KEY = r"^DAY(\d+)_A\d+_[A-Z]+_(\d{6,8})_(\d{6,8})$"
CONTEXT_LINE = r"DAY(\d+) (\d{1,2}:\d{2}:\d{2}) - (\d{1,2}:\d{2}:\d{2})"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clip_path(path: str | Column) -> Column:
    """A clip's path as a struct; null if the directories don't agree with the name."""
    p = _c(path)
    part = lambda i: F.regexp_extract(p, CLIP_PATH, i)
    agree = p.rlike(CLIP_PATH) & (part(1) == part(5)) & (part(2) == part(6)) & (part(3) == part(4))
    fields = F.struct(
        part(3).try_cast("int").alias("day"), part(1).try_cast("int").alias("agent_id"),
        F.initcap(part(2)).alias("agent"), part(7).alias("token"),
    )
    return F.when(agree, fields)


def context_windows(text: str | Column) -> Column:
    """All windows written as DAYn H:MM:SS - H:MM:SS, as an array of structs of texts."""
    t = _c(text)
    group = lambda i: F.regexp_extract_all(t, F.lit(CONTEXT_LINE), F.lit(i))
    zipped = F.arrays_zip(group(1).alias("day"), group(2).alias("start"), group(3).alias("end"))
    return F.transform(zipped, lambda z: F.struct(z["day"].cast("int").alias("day"), z["start"].alias("start"), z["end"].alias("end")))


def _span(key: Column, pattern: str, end: Column) -> Column:
    start = tm.loose_token_millis(F.regexp_extract(key, pattern, 2))
    fields = F.struct(F.regexp_extract(key, pattern, 1).try_cast("int").alias("day"), start.alias("start_ms"), end.alias("end_ms"))
    return F.when(key.rlike(pattern) & start.isNotNull() & end.isNotNull(), fields)


def context_key(key: str | Column) -> Column:
    """(day, start_ms, end_ms) of a key of a context; null if it is none."""
    k = _c(key)
    return _span(k, CONTEXT_KEY, tm.loose_token_millis(F.regexp_extract(k, CONTEXT_KEY, 3)))


def caption_key(key: str | Column, clip_ms: int = 30_000) -> Column:
    """(day, start_ms, end_ms) of a caption's key: a clip of ``clip_ms``, or a span with both ends."""
    k = _c(key)
    clip = _span(k, CLIP_KEY, tm.loose_token_millis(F.regexp_extract(k, CLIP_KEY, 2)) + clip_ms)
    return F.coalesce(clip, _span(k, SPAN_KEY, tm.loose_token_millis(F.regexp_extract(k, SPAN_KEY, 3))))


def mentioned(text: Column, names: Sequence[str]) -> Column:
    """Names that occur as words, in any case, in the order given."""
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b{n}\b"), F.lit(n)) for n in names]))


def parse_contexts(contexts: Column, names: Sequence[str], *more: Column) -> Column:
    """What a question's contexts say, whatever their form: JSON of a map by window, of a list of lines,
    or free text.

    (kind, status, windows, day, start_ms, end_ms, members): all windows found in keys and lines, the
    span of those of the first day, and the names mentioned there or in ``more`` texts.
    """
    t = F.ltrim(contexts)
    kind = F.when(t.startswith("{"), "dict").when(t.startswith("["), "list").otherwise("text")
    keys = F.coalesce(F.map_keys(F.from_json(F.when(kind == "dict", contexts), "map<string,string>")), F.array().cast("array<string>"))
    lines = F.transform(
        context_windows(contexts),
        lambda w: F.struct(w["day"].alias("day"), tm.clock_millis(w["start"]).alias("start_ms"), tm.clock_millis(w["end"]).alias("end_ms")),
    )
    found = F.filter(F.concat(F.transform(keys, context_key), lines), lambda w: w["start_ms"].isNotNull())
    day = F.array_min(F.transform(found, lambda w: w["day"]))
    same = F.filter(found, lambda w: w["day"] == day)
    return F.struct(
        kind.alias("kind"), F.when(F.size(found) > 0, "ok").otherwise("failed").alias("status"), F.size(found).alias("windows"), day.alias("day"),
        F.array_min(F.transform(same, lambda w: w["start_ms"])).alias("start_ms"), F.array_max(F.transform(same, lambda w: w["end_ms"])).alias("end_ms"),
        mentioned(F.concat_ws(" ", contexts, *more), names).alias("members"),
    )


def window_list(json: Column, day: Column, start: Column, end: Column) -> Column:
    """Windows (day, start, end) of a JSON list whose numbers are none negative; without any, the one
    of the other columns, if that is valid."""
    whole = lambda c: F.coalesce(c.cast("string").try_cast("double").try_cast("long"), F.lit(-1))
    real = lambda c: F.coalesce(c.cast("string").try_cast("double"), F.lit(-1.0))
    window = lambda d, s, e: F.struct(whole(d).alias("day"), real(s).alias("start"), real(e).alias("end"))
    valid = lambda w: (w["day"] >= 0) & (w["start"] >= 0) & (w["end"] >= 0)
    listed = F.from_json(F.when(F.ltrim(json).startswith("["), json), "array<struct<day:string,start_time:string,end_time:string>>")
    found = F.filter(F.transform(listed, lambda w: window(w["day"], w["start_time"], w["end_time"])), valid)
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.filter(F.array(window(day, start, end)), valid))


def members_or_all(text: Column, everyone: Sequence[str]) -> Column:
    """Members of a list joined by ``;``; an empty list stands for everyone."""
    named = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda m: m != "")
    return F.when(F.size(named) > 0, named).otherwise(F.array(*[F.lit(e) for e in everyone]))


def asking_user(question: Column, members: Column, names: Sequence[str]) -> Column:
    """(user, how): the name in an explicit phrase, else the only name mentioned, else the only member
    of the context, else UNKNOWN."""
    any_name = "|".join(names)
    view = "(?:view|perspective|camera|video)"
    phrases = (rf"(?i)\bfrom\s+({any_name})'s\s+{view}\b", rf"(?i)\baccording\s+to\s+({any_name})\b", rf"(?i)\bin\s+({any_name})'s\s+{view}\b")
    explicit = F.coalesce(*[F.nullif(F.lower(F.regexp_extract(question, p, 1)), F.lit("")) for p in phrases])
    said = mentioned(question, names)
    user = F.when(explicit.isNotNull(), explicit).when(F.size(said) == 1, said[0]).when(F.size(members) == 1, members[0]).otherwise("UNKNOWN")
    how = F.when(explicit.isNotNull(), "explicit").when((F.size(said) == 1) | (F.size(members) == 1), "inferred").otherwise("unknown")
    return F.struct(user.alias("user"), how.alias("how"))


def json_block(text: str | Column) -> Column:
    """The JSON object of a reply: the fenced block if there is one, else from the first brace to the last."""
    t = _c(text)
    fenced = F.nullif(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(fenced, braces)


def stable_id(*parts: str | Column) -> Column:
    """Non-empty parts joined by underscores, slashes and blanks replaced."""
    filled = [F.nullif(_c(p).cast("string"), F.lit("")) for p in parts]
    return F.translate(F.concat_ws("_", *filled), "/ ", "-_")


def trailing_number(text: str | Column) -> Column:
    """The number at the end of an id, as long; null without one."""
    return F.regexp_extract(_c(text), r"(\d+)$", 1).try_cast("long")


def number_or(text: str | Column, default: float) -> Column:
    return F.coalesce(_c(text).try_cast("double"), F.lit(float(default)))


def truncated_int_or(text: str | Column, default: int) -> Column:
    """A number's integer part, the fraction dropped."""
    d = _c(text).try_cast("double")
    return F.coalesce(F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)), F.lit(default)).cast("long")
