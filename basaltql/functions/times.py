"""Times with modifiers, time zones and intervals, as Column expressions. Modifiers and formats are compiled with the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basaltql.functions.formats import date_format
from basaltql.functions.scalar import FUNCTIONS, _literal, named

#: Steps of a fixed length, in seconds.
SECONDS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}
#: Steps along the calendar, in months.
MONTHS = {"month": 1, "year": 12}
NUMBER = r"^[-+]?[0-9]+(\.[0-9]*)?$"


def _text(x: Column | str) -> str:
    return _literal(x) if isinstance(x, Column) else x


def _plus(t: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(t) + micros)


def _by_seconds(t: Column, seconds: float) -> Column:
    return t + F.make_dt_interval(secs=F.lit(round(seconds, 6)).cast("decimal(18,6)"))


def _by_months(t: Column, months: int) -> Column:
    """The same day's number and time so many months on; a day that the month lacks runs over into the next one."""
    first = F.date_trunc("month", t)
    return F.add_months(first, F.lit(months)).cast("timestamp") + (t - first)


def _step(t: Column, word: str) -> Column | None:
    """t moved by a step such as "+3 days"; None if the words are no step."""
    amount, _, unit = word.partition(" ")
    if not unit:
        cut = len(word.rstrip("abcdefghijklmnopqrstuvwxyz"))
        amount, unit = word[:cut], word[cut:]
    unit = unit.strip().removesuffix("s")
    try:
        n = float(amount)
    except ValueError:
        return None
    if unit in SECONDS:
        return _by_seconds(t, n * SECONDS[unit])
    return _by_months(t, int(n) * MONTHS[unit]) if unit in MONTHS else None


def _modified(t: Column, modifier: str) -> Column:
    """t after one modifier; null for words that are none."""
    match modifier.lower().split():
        case ["utc" | "localtime" | "auto" | "subsec" | "unixepoch" | "julianday"]:
            return t
        case ["start", "of", ("year" | "month" | "day" | "hour" | "minute") as unit]:
            return F.date_trunc(unit, t)
        case ["weekday", day] if day in tuple("0123456"):
            ahead = F.pmod(F.lit(int(day)) + 1 - F.dayofweek(t), F.lit(7))
            return t + F.make_dt_interval(days=ahead)
        case words:
            moved = _step(t, " ".join(words))
            return F.lit(None).cast("timestamp") if moved is None else moved


def time_value(t: Column, *modifiers: Column | str) -> Column:
    """A time value with its modifiers applied in turn; null for an unknown modifier. A number is a Julian day, or with
    'unixepoch' seconds."""
    mods = [_text(m) for m in modifiers]
    shown = t.cast("string")
    number = F.when(shown.rlike(NUMBER), shown.try_cast("double"))
    micros = number * 1_000_000 if "unixepoch" in [m.lower() for m in mods] else (number - 2440587.5) * 86_400_000_000
    out = F.when(number.isNotNull(), F.timestamp_micros(F.round(micros / 1000).cast("long") * 1000)).otherwise(shown.try_cast("timestamp"))
    for m in mods:
        out = _modified(out, m)
    return out


named("JULIANDAY")(lambda t, *m: F.unix_micros(time_value(t, *m)) / 86_400_000_000.0 + 2440587.5)
named("UNIXEPOCH")(lambda t, *m: F.unix_seconds(time_value(t, *m)))
named("DATE")(lambda t, *m: F.date_format(time_value(t, *m), "yyyy-MM-dd"))
named("TIME")(lambda t, *m: F.date_format(time_value(t, *m), "HH:mm:ss"))
named("DATETIME")(lambda t, *m: F.date_format(time_value(t, *m), "yyyy-MM-dd HH:mm:ss"))
named("CURRENT_TIME", "CURTIME", "UTC_TIME")(lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"))


@named("TIMEDIFF")
def timediff(a: Column, b: Column) -> Column:
    """The signed difference as days and a time, +0000-00-DD HH:MM:SS.SSS."""
    gap = F.unix_micros(time_value(a)) - F.unix_micros(time_value(b))
    ms = F.floor(F.abs(gap) / 1000)
    part = lambda size, of: F.pmod(F.floor(ms / size), F.lit(of))
    return F.when(gap.isNotNull(), F.format_string("%s0000-00-%02d %02d:%02d:%02d.%03d", F.when(gap < 0, "-").otherwise("+"), F.floor(ms / 86_400_000), part(3_600_000, 24), part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000))))


@named("FROM_UNIXTIME")
def from_unixtime(seconds: Column, model: Column | str | None = None) -> Column:
    t = F.timestamp_micros((seconds.cast("double") * 1_000_000).cast("long"))
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss") if model is None else date_format(t, model)


_OFFSET = r"^[+-]\d{2}:\d{2}$"


def _minutes(offset: Column) -> Column:
    """Minutes of an offset such as +05:30; 0 for other texts."""
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    return F.when(offset.rlike(_OFFSET), sign * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int"))).otherwise(0)


@named("FROM_TZ")
def from_tz(t: Column, zone: Column) -> Column:
    """A time with an offset after it; a zone that isn't numeric counts as +00:00."""
    return F.concat(F.trim(t.cast("string")), F.when(F.trim(zone).rlike(_OFFSET), F.trim(zone)).otherwise("+00:00"))


@named("__AT_TIME_ZONE")
def at_time_zone(t: Column, zone: Column) -> Column:
    """The wall clock in another zone of a time that may end in an offset."""
    s = F.trim(t.cast("string"))
    own = F.regexp_extract(s, r"([+-]\d{2}:\d{2})$", 1)
    clock = F.trim(F.regexp_replace(s, r"[+-]\d{2}:\d{2}$", "")).try_cast("timestamp")
    return F.date_format(_plus(clock, (_minutes(zone) - _minutes(own)).cast("long") * 60_000_000), "yyyy-MM-dd HH:mm:ss")


@named("TZ_OFFSET")
def tz_offset(zone: Column) -> Column:
    return F.when(zone.isNotNull(), F.when(F.trim(zone).rlike(r"^[+-]\d{1,2}:\d{2}$"), F.trim(zone)).otherwise("+00:00"))


@named("TO_YMINTERVAL")
def to_yminterval(s: Column) -> Column:
    """Years and months in days of 365 and 30."""
    part = lambda i: F.regexp_extract(s, r"(-?\d+)-(\d+)", i).try_cast("int")
    return part(1) * 365 + part(2) * 30


@named("TO_DSINTERVAL")
def to_dsinterval(s: Column) -> Column:
    """Days and a time of day, in days."""
    pattern = r"^(?:(-?\d+)\s+)?(-?\d+)?:?(\d+)?:?(\d+(?:\.\d+)?)?"
    part = lambda i: F.coalesce(F.regexp_extract(F.trim(s), pattern, i).try_cast("double"), F.lit(0.0))
    return F.when(s.isNotNull(), part(1) + part(2) / 24 + part(3) / 1440 + part(4) / 86400)


@named("NUMTODSINTERVAL")
def numtodsinterval(n: Column, unit: Column | str) -> Column:
    """A number of units, in days."""
    return n.cast("double") * SECONDS[_text(unit).lower()] / 86400


@named("NUMTOYMINTERVAL")
def numtoyminterval(n: Column, unit: Column | str) -> Column:
    """A calendar interval; adding it to a date moves whole months."""
    months = n.cast("int") * (12 if _text(unit).upper() == "YEAR" else 1)
    return F.make_ym_interval(F.lit(0), months)


@named("EXTRACT")
def extract(field: Column | str, t: Column) -> Column:
    """A field of a time; seconds keep their fraction, and the zone's fields are 0 as times are in UTC."""
    f = _text(field).upper()
    if f in ("TIMEZONE_HOUR", "TIMEZONE_MINUTE"):
        return F.when(t.isNotNull(), 0)
    return F.date_part(F.lit(f), t).cast("double") if f == "SECOND" else F.date_part(F.lit(f), t)


FUNCTIONS["TO_BINARY_DOUBLE"] = lambda x: x.try_cast("double")
FUNCTIONS["TO_BINARY_FLOAT"] = lambda x: x.try_cast("float")
