"""Format models of times and numbers, and the dialect's casts. Models are compiled when the plan is made."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from basaltql.functions.scalar import FUNCTIONS, _literal, named

Part = Callable[[Column], Column]
MICROS_OF_DAY = 86_400_000_000


def _text(x: Column | str) -> str:
    return _literal(x) if isinstance(x, Column) else str(x)


def _shown(java: str) -> Part:
    return lambda t: F.date_format(t, java)


def _number(f: Part, width: int = 0) -> Part:
    """A computed number, with zeros before it up to a width."""
    return lambda t: F.lpad(f(t).cast("string"), width, "0") if width else f(t).cast("string")


def _of_day(t: Column) -> Column:
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def _julian_number(t: Column) -> Column:
    return F.datediff(t, F.lit("1970-01-01").cast("date")) + 2440588


def _sunday_weeks(t: Column) -> Column:
    """Weeks of the year that begin on Sunday; days before the first Sunday are in week 0."""
    return F.floor((F.dayofyear(t) + 7 - F.dayofweek(t)) / 7)


def _monday_weeks(t: Column) -> Column:
    return F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7)


def _julian(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / float(MICROS_OF_DAY) + 2440587.5


ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]

#: Elements of TO_CHAR's date models.
DATE_ELEMENTS: dict[str, Part] = {
    "YYYY": _shown("yyyy"), "RRRR": _shown("yyyy"), "YY": _shown("yy"), "RR": _shown("yy"),
    "IYYY": _number(lambda t: F.date_part(F.lit("YEAROFWEEK"), t), 4), "CC": _number(lambda t: F.ceil(F.year(t) / 100), 2),
    "Q": _number(F.quarter), "MM": _shown("MM"), "MON": _shown("MMM"), "MONTH": _shown("MMMM"),
    "RM": lambda t: F.element_at(F.array(*map(F.lit, ROMAN)), F.month(t)),
    "W": _number(lambda t: F.ceil(F.dayofmonth(t) / 7)), "WW": _number(lambda t: F.ceil(F.dayofyear(t) / 7), 2), "IW": _number(F.weekofyear, 2),
    "DDD": _shown("DDD"), "DD": _shown("dd"), "D": _number(F.dayofweek), "DY": _shown("EEE"), "DAY": _shown("EEEE"), "J": _number(_julian_number),
    "HH24": _shown("HH"), "HH12": _shown("hh"), "HH": _shown("hh"), "MI": _shown("mm"), "SS": _shown("ss"), "SSSSS": _number(_of_day), "AM": _shown("a"), "PM": _shown("a"),
}
NAMES = {"MON", "MONTH", "DY", "DAY"}
_MODEL = re.compile(r'"([^"]*)"|FF([0-9]?)|(' + "|".join(sorted(DATE_ELEMENTS, key=len, reverse=True)) + r")|(.)", re.IGNORECASE | re.DOTALL)


def to_char_date(t: Column, model: str) -> Column:
    """TO_CHAR of a time. Names follow the case in which their element is written; FM changes nothing, as names have no padding."""
    parts: list[Column] = []
    for quoted, fraction, name, other in _MODEL.findall(re.sub("^FM", "", model, flags=re.IGNORECASE)):
        if name:
            c = DATE_ELEMENTS[name.upper()](t)
            if name.upper() in NAMES:
                c = F.upper(c) if name.isupper() else F.lower(c) if name.islower() else c
            parts.append(c)
        else:
            parts.append(F.lit(quoted or other))
        if not (quoted or name or other) or fraction:
            places = min(int(fraction or 6), 6)
            parts[-1] = F.substring(F.date_format(t, "SSSSSS"), 1, places)
    return F.concat(*parts)


def is_number_model(model: str) -> bool:
    return bool(re.fullmatch(r"(?i)(FM)?[S$L]?[09,.GDVX]*(MI|PR|S)?|(FM)?R[NM]N?", model)) and any(c in "09xX" for c in model)


@named("TO_CHAR")
def to_char(x: Column, model: Column | str | None = None) -> Column:
    """By the model: of digits for numbers, else of date elements. Without a model, the value as text."""
    if model is None:
        return x.cast("string")
    text = _text(model)
    return FUNCTIONS["TO_CHAR_NUMBER"](x, text) if is_number_model(text) else to_char_date(x, text)


#: What reads each element of a date model: letters where the field's width is fixed by its neighbours, and where it is not.
READERS = {"YYYY": ("yyyy", "yyyy"), "RRRR": ("yyyy", "yyyy"), "YY": ("yy", "yy"), "RR": ("yy", "yy"), "MONTH": ("MMMM", "MMMM"), "MON": ("MMM", "MMM"), "MM": ("MM", "M"), "DDD": ("DDD", "D"), "DD": ("dd", "d"), "HH24": ("HH", "H"), "HH12": ("hh", "h"), "HH": ("hh", "h"), "MI": ("mm", "m"), "SS": ("ss", "s"), "AM": ("a", "a"), "PM": ("a", "a")}
_READ = re.compile(r'"([^"]*)"|FF([0-9]?)|(' + "|".join(sorted(READERS, key=len, reverse=True)) + r")|(.)", re.IGNORECASE | re.DOTALL)


def read_time(s: Column, model: Column | str | None) -> Column:
    """A time read by a model, null where the text doesn't follow it; J is a Julian day's number. ISO without a model."""
    text = F.trim(s.cast("string"))
    if model is None or not _text(model).strip():
        return F.call_function("try_to_timestamp", text)
    plain = _text(model).strip()
    if plain.upper() == "J":
        return F.timestamp_seconds((text.try_cast("long") - 2440588) * 86400)
    found = _READ.findall(plain)
    java = []
    for (quoted, fraction, name, other), after in zip(found, [*found[1:], ("", "", "", " ")], strict=True):
        if name:
            adjacent = bool(after[2]) or not any(after)
            java.append(READERS[name.upper()][0 if adjacent else 1])
        elif quoted or other:
            java.append("".join(f"'{c}'" if c.isalpha() else "''" if c == "'" else c for c in quoted or other))
        else:
            java.append("S" * max(1, min(int(fraction or 6), 9)))
    read = F.try_to_timestamp(text, F.lit("".join(java)))
    if any(name.upper() == "RR" for _, _, name, _ in found):
        #: Two digits from 50 on lie in the last century.
        read = F.when(F.year(read) >= 2050, F.add_months(read, F.lit(-1200)).cast("timestamp") + (read - F.date_trunc("day", read))).otherwise(read)
    return read


@named("TO_DATE")
def to_date(s: Column, model: Column | str | None = None) -> Column:
    """A date; a time where the model has one."""
    t = read_time(s, model)
    return t if model is not None and re.search(r"HH|MI|SS|FF", _text(model).upper()) else t.cast("date")


@named("TO_TIMESTAMP")
def to_timestamp(s: Column, model: Column | str | None = None) -> Column:
    return read_time(s, model)


@named("TO_TIMESTAMP_TZ")
def to_timestamp_tz(s: Column, model: Column | str | None = None) -> Column:
    """The wall clock; an offset at the end is dropped, and the model's zone elements with it."""
    clock = F.regexp_replace(s, r"\s*[-+][0-9]{1,2}:[0-9]{2}\s*$", "")
    return read_time(clock, None if model is None else re.split(r"(?i)\s*TZ[HMRD]", _text(model))[0])


@named("STR_TO_DATE")
def str_to_date(s: Column, model: Column | str | None = None) -> Column:
    """ISO times; the format changes nothing."""
    return F.call_function("try_to_timestamp", F.trim(s.cast("string")))


#: Codes of strftime.
STRFTIME_CODES: dict[str, Part] = {
    "Y": _shown("yyyy"), "m": _shown("MM"), "d": _shown("dd"), "e": lambda t: F.lpad(F.dayofmonth(t).cast("string"), 2, " "), "H": _shown("HH"), "I": _shown("hh"), "k": lambda t: F.lpad(F.hour(t).cast("string"), 2, " "), "l": lambda t: F.lpad(F.date_format(t, "h"), 2, " "),
    "M": _shown("mm"), "S": _shown("ss"), "f": _shown("ss.SSS"), "j": _shown("DDD"), "p": _shown("a"), "P": lambda t: F.lower(F.date_format(t, "a")), "s": lambda t: F.unix_seconds(t.cast("timestamp")).cast("string"), "J": lambda t: _julian(t).cast("string"),
    "w": _number(lambda t: F.dayofweek(t) - 1), "u": _number(lambda t: F.weekday(t) + 1), "U": _number(_sunday_weeks, 2), "W": _number(_monday_weeks, 2), "V": _number(F.weekofyear, 2), "G": DATE_ELEMENTS["IYYY"],
    "F": _shown("yyyy-MM-dd"), "T": _shown("HH:mm:ss"), "R": _shown("HH:mm"), "y": _shown("yy"), "b": _shown("MMM"), "%": lambda t: F.lit("%"),
}
_SUFFIX = {1: "st", 2: "nd", 3: "rd", 21: "st", 22: "nd", 23: "rd", 31: "st"}


def _day_with_suffix(t: Column) -> Column:
    day, suffix = F.dayofmonth(t), F.lit("th")
    for n, letters in _SUFFIX.items():
        suffix = F.when(day == n, letters).otherwise(suffix)
    return F.concat(day.cast("string"), suffix)


#: Codes of DATE_FORMAT.
DATE_FORMAT_CODES: dict[str, Part] = {
    "Y": _shown("yyyy"), "y": _shown("yy"), "m": _shown("MM"), "c": _shown("M"), "M": _shown("MMMM"), "b": _shown("MMM"), "d": _shown("dd"), "e": _shown("d"), "D": _day_with_suffix, "j": _shown("DDD"), "W": _shown("EEEE"), "a": _shown("EEE"), "w": _number(lambda t: F.dayofweek(t) - 1),
    "H": _shown("HH"), "k": _shown("H"), "h": _shown("hh"), "I": _shown("hh"), "l": _shown("h"), "i": _shown("mm"), "s": _shown("ss"), "S": _shown("ss"), "f": _shown("SSSSSS"), "p": _shown("a"), "T": _shown("HH:mm:ss"), "r": _shown("hh:mm:ss a"), "%": lambda t: F.lit("%"),
}


def by_codes(codes: dict[str, Part], model: str, t: Column) -> Column:
    """Text with %-codes; an unknown code stands for its letter."""
    out = [codes[code](t) if code in codes else F.lit(code or plain) for code, plain in re.findall(r"%(.)|([^%]+|%$)", model, re.DOTALL)]
    return F.concat(*out) if out else F.lit("")


@named("STRFTIME")
def strftime(model: Column | str, t: Column, *modifiers: Column | str) -> Column:
    from basaltql.functions.times import time_value

    return by_codes(STRFTIME_CODES, _text(model), time_value(t, *modifiers))


@named("DATE_FORMAT", "TIME_FORMAT")
def date_format(t: Column, model: Column | str) -> Column:
    return by_codes(DATE_FORMAT_CODES, _text(model), t.cast("timestamp"))


@named("TO_NUMBER")
def to_number(x: Column, model: Column | str | None = None) -> Column:
    """The number a text holds, else null. With a model, grouping and currency signs are dropped first."""
    s = F.trim(x.cast("string"))
    return (s if model is None else F.regexp_replace(s, r"[^0-9.\-]", "")).try_cast("double")


#: Names of the units of TRUNC and ROUND.
UNITS = {"YYYY": "year", "YYY": "year", "YY": "year", "Y": "year", "YEAR": "year", "SYYYY": "year", "SYEAR": "year", "Q": "quarter", "MM": "month", "MON": "month", "MONTH": "month", "RM": "month", "IW": "week", "IYYY": "isoyear", "IY": "isoyear", "I": "isoyear", "WW": "yearweek", "W": "monthweek", "DAY": "sunday", "DY": "sunday", "D": "sunday", "DD": "day", "DDD": "day", "J": "day", "HH": "hour", "HH12": "hour", "HH24": "hour", "MI": "minute"}


def _days(t: Column, n: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(t) + n.cast("long") * MICROS_OF_DAY)


def trunc_time(t: Column, unit: str) -> Column:
    t = t.cast("timestamp")
    day = F.date_trunc("day", t)
    if unit == "isoyear":
        return F.date_trunc("week", F.make_timestamp(F.date_part(F.lit("YEAROFWEEK"), t), F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0)))
    back = {"sunday": F.dayofweek(t) - 1, "yearweek": F.pmod(F.dayofyear(t) - 1, F.lit(7)), "monthweek": F.pmod(F.dayofmonth(t) - 1, F.lit(7))}.get(unit)
    return F.date_trunc(unit, t) if back is None else _days(day, -back)


def round_time(t: Column, unit: str) -> Column:
    """The nearer start of the unit: years from July on, quarters from the 16th of their second month, months from the 16th."""
    t = t.cast("timestamp")
    start = trunc_time(t, unit)
    if unit in ("year", "quarter", "month"):
        months = {"year": 12, "quarter": 3, "month": 1}[unit]
        late = {"year": F.month(t) >= 7, "quarter": (F.month(t) - F.month(start) > 1) | ((F.month(t) - F.month(start) == 1) & (F.dayofmonth(t) >= 16)), "month": F.dayofmonth(t) >= 16}[unit]
        return F.when(late, F.add_months(start, F.lit(months)).cast("timestamp")).otherwise(start)
    length = {"day": 1, "hour": 1 / 24, "minute": 1 / 1440, "isoyear": 365}.get(unit, 7) * MICROS_OF_DAY
    late = 2 * (F.unix_micros(t) - F.unix_micros(start)) >= length
    return F.when(late, F.timestamp_micros(F.unix_micros(start) + int(length))).otherwise(start)


@named("TRUNC")
def trunc(x: Column, n: Column | str | int | None = None) -> Column:
    """A number towards zero, to n places; a time to the start of a unit."""
    unit = None if n is None else UNITS.get(_text(n).upper())
    if unit:
        return trunc_time(x, unit)
    p = F.lit(1.0) if n is None else F.pow(F.lit(10.0), n if isinstance(n, Column) else F.lit(n))
    return F.signum(x) * F.floor(F.abs(x) * p) / p


@named("ROUND")
def round_(x: Column, n: Column | str | int | None = None) -> Column:
    """A number half up, to n places; a time to the nearer start of a unit."""
    unit = None if n is None else UNITS.get(_text(n).upper())
    return round_time(x, unit) if unit else F.call_function("round", x, F.lit(0) if n is None else n if isinstance(n, Column) else F.lit(n))


def cast(x: Column, kind: str) -> Column:
    """CAST(x AS kind): null where a value doesn't fit. NUMBER(p, s) rounds half up, character types cut at their length."""
    name, *sizes = re.findall(r"[A-Z_0-9]+", kind.upper())
    if name in ("VARCHAR2", "VARCHAR", "NVARCHAR2", "CHAR", "CLOB", "TEXT"):
        return F.left(x.cast("string"), F.lit(int(sizes[0]))) if sizes else x.cast("string")
    if name in ("NUMBER", "NUMERIC", "DECIMAL") and sizes:
        return x.cast("string").try_cast(f"decimal({sizes[0]},{sizes[1] if len(sizes) > 1 else 0})")
    return x.try_cast({"NUMBER": "double", "NUMERIC": "double", "REAL": "double", "INTEGER": "long", "INT": "long", "BLOB": "binary", "DATE": "date"}.get(name, name.lower()))
