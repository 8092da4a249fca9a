"""Times as Columns. All text is UTC whatever the session's zone: fields are computed from whole microseconds, and zoneless text is read as UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000
_SECOND = 1_000_000


def parse_utc(text: Column, strict: bool = True) -> Column:
    """ISO text to timestamp; without a zone it is UTC, without a time midnight. strict: bad text is an error, else null."""
    text = F.trim(text)
    zoned = text.rlike(r"\d[T ].*(?:Z|[+-]\d{2}(?::?\d{2})?)$")
    full = F.when(zoned, text).when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z")))
    return F.to_timestamp(full) if strict else F.try_to_timestamp(full)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def micros_of_ntz(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, taken as UTC."""
    return micros(parse_utc(ts.cast("string")))


def utc_date(us: Column) -> Column:
    """The UTC date of microseconds since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), ((us - F.pmod(us, F.lit(_DAY))) / _DAY).cast("int"))


def _clock(us: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss of microseconds since 1970."""
    seconds = (F.pmod(us, F.lit(_DAY)) / _SECOND).cast("int")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(utc_date(us).cast("string"), F.lit("T"), two(seconds / 3600), F.lit(":"), two(seconds % 3600 / 60), F.lit(":"), two(seconds % 60))


def divide_half_even(value: Column, by: Column) -> Column:
    """Whole-number quotient, halves to the even neighbour, for positive by."""
    rest = F.pmod(value, by)
    low = F.floor((value - rest) / by).cast("long")
    exact = F.when(rest == 0, low)
    up = (2 * rest > by) | ((2 * rest == by) & (F.pmod(low, F.lit(2)) == 1))
    return F.coalesce(exact, low + F.when(up, 1).otherwise(0))


def midpoint(start: Column, stop: Column) -> Column:
    return F.timestamp_micros(micros(start) + divide_half_even(micros(stop) - micros(start), F.lit(2).cast("long")))


def iso_text(ts: Column, zone: str = "Z") -> Column:
    """ISO text with zone; a fraction (six digits) only if there is one."""
    us = micros(ts)
    part = F.pmod(us, F.lit(_SECOND))
    fraction = F.when(part == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0")))
    return F.concat(_clock(us), fraction, F.lit(zone))


def millis_text(ts: Column) -> Column:
    """ISO text with milliseconds, cut off, not rounded."""
    us = micros(ts)
    part = (F.pmod(us, F.lit(_SECOND)) / 1000).cast("int")
    return F.concat(_clock(us), F.lit("."), F.lpad(part.cast("string"), 3, "0"), F.lit("Z"))


def time_of_name(name: Column) -> Column:
    """Time in a file name YYYYMMDDThhmmss[fraction][Z][_n].geojson, six digits of the fraction; null for other names."""
    pattern = r"^(\d{8}T\d{6})(\d{0,6})\d*Z?(?:_\d+)?(?:\.\w+)?$"
    day, part = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    return F.when(day != "", F.try_to_timestamp(F.concat(day, F.rpad(part, 6, "0"), F.lit("Z")), F.lit("yyyyMMdd'T'HHmmssSSSSSSX")))


def safe_name(time_text: Column, suffix: str = ".geojson") -> Column:
    """File name of a time: its letters and digits and a suffix. An error if nothing is left; null of null."""
    kept = F.regexp_replace(time_text, r"[^\p{L}\p{N}]", "")
    empty = F.raise_error(F.concat(F.lit("no letter or digit for a file name in: "), time_text)).cast("string")
    return F.when(kept == "", empty).otherwise(F.concat(kept, F.lit(suffix)))


def month_bounds(month: str) -> tuple[str, str]:
    """First instants of a month YYYY-MM and of the next, as timestamp text."""
    year, dash, number = month.partition("-")
    if not (dash and len(year) == 4 and len(number) == 2 and (year + number).isdecimal() and 1 <= int(number) <= 12):
        raise ValueError(f"not a month of the form YYYY-MM: {month!r}")
    y, m = int(year), int(number)
    nxt = (y + 1, 1) if m == 12 else (y, m + 1)
    return f"{y:04}-{m:02}-01T00:00:00Z", f"{nxt[0]:04}-{nxt[1]:02}-01T00:00:00Z"


def month_micros(month: str) -> tuple[int, int]:
    """The bounds of a month as microseconds since 1970."""
    low, high = (dt.datetime.fromisoformat(t) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) for t in month_bounds(month))
    return low // dt.timedelta(microseconds=1), high // dt.timedelta(microseconds=1)
