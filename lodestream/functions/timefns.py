"""Clock tokens, days and time buckets as integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def day_number(ts: str | Column) -> Column:
    """Days since 1970-01-01; independent of the session's time zone for timestamps without zone."""
    return F.unix_date(_c(ts).cast("date")).cast("long")


def millis_of_day(ts: str | Column) -> Column:
    t = _c(ts)
    seconds = F.date_part(F.lit("SECOND"), t)
    return (F.hour(t).cast("long") * 3_600_000 + F.minute(t).cast("long") * 60_000 + F.floor(seconds * 1000)).cast("long")


def token_millis(token: str | Column) -> Column:
    """HHMMSScc as milliseconds of the day; null unless it is eight digits in range."""
    t = _c(token)
    part = lambda at: F.substring(t, at, 2).try_cast("long")
    valid = t.rlike("^[0-9]{8}$") & (part(3) < 60) & (part(5) < 60)
    return F.when(valid, part(1) * 3_600_000 + part(3) * 60_000 + part(5) * 1000 + part(7) * 10)


def loose_token_millis(token: str | Column) -> Column:
    """Like :func:`token_millis` on the digits of any text; six or seven digits lack hundredths."""
    padded = lambda digits: F.when(F.length(digits).between(6, 8), _bind(F.rpad(digits, 8, "0"), token_millis))
    return _bind(F.regexp_replace(_c(token), "[^0-9]", ""), padded)


def clock_millis(clock: str | Column) -> Column:
    """H:M:S with an optional fraction as milliseconds; null if it is no clock time."""
    c = _c(clock)
    pattern = r"^(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,3}))?$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    valid = c.rlike(pattern) & (part(2).try_cast("long") < 60) & (part(3).try_cast("long") < 60)
    fraction = F.rpad(part(4), 3, "0").cast("long")
    whole = part(1).try_cast("long") * 3_600_000 + part(2).try_cast("long") * 60_000 + part(3).try_cast("long") * 1000
    return F.when(valid, whole + fraction)


def millis_clock(ms: str | Column) -> Column:
    """Milliseconds as HH:MM:SS.mmm, the hour modulo 24."""
    m = F.pmod(_c(ms), F.lit(DAY_MS))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(
        two(m / 3_600_000), F.lit(":"), two(F.pmod(F.floor(m / 60_000), F.lit(60))), F.lit(":"),
        two(F.pmod(F.floor(m / 1000), F.lit(60))), F.lit("."), F.lpad(F.pmod(m, F.lit(1000)).cast("string"), 3, "0"),
    )


def day_period(ms_of_day: str | Column) -> Column:
    """morning from 6, afternoon from 12, evening from 17, night otherwise."""
    hour = F.floor(_c(ms_of_day) / 3_600_000)
    return (
        F.when((hour >= 6) & (hour < 12), "morning").when((hour >= 12) & (hour < 17), "afternoon")
        .when((hour >= 17) & (hour < 24), "evening").otherwise("night")
    )


def wrap_midnight(start: str | Column, end: str | Column, day: int = DAY_MS) -> Column:
    """The end of an interval, a day later if it lies before the start."""
    return F.when(_c(end) < _c(start), _c(end) + day).otherwise(_c(end))
