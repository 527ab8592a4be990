"""Search in texts: positions of parts and regular expressions with positions, occurrences and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basaltql.functions.scalar import _literal, named

POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "blank": "Blank", "cntrl": "Cntrl", "print": "Print", "graph": "Graph", "xdigit": "XDigit"}
#: Flags of the dialect and what Java calls them; c (case counts) is the default.
FLAGS = {"i": "i", "n": "s", "m": "m", "x": "x"}


def compiled(p: Column, flags: Column | str | None = None) -> Column:
    """A pattern in Java's syntax; Catalyst folds it where the pattern is a literal."""
    out = F.replace(p, F.lit("[:space:]"), F.lit(r"\s"))
    for name, java in POSIX.items():
        out = F.replace(out, F.lit(f"[:{name}:]"), F.lit(rf"\p{{{java}}}"))
    given = "" if flags is None else _literal(flags) if isinstance(flags, Column) else flags
    letters = "".join(FLAGS[f] for f in given if f in FLAGS)
    return F.concat(F.lit(f"(?{letters})"), out) if letters else out


def _int(x: Column | int | None, default: int) -> int:
    return default if x is None else int(_literal(x)) if isinstance(x, Column) else x


def _rest(s: Column, at: int) -> Column:
    return s if at == 1 else F.substr(s, F.lit(at))


def _nth(text: Column, p: Column, nth: int) -> tuple[Column, Column]:
    """(start, found): the place in text of the nth match, from 1, and the match; nulls if there is none."""
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.call_function("split", text, p, F.lit(-1))
    length = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x)) if n else F.lit(0)
    return F.when(F.size(found) >= nth, length(gaps, nth) + length(found, nth - 1) + 1), F.try_element_at(found, F.lit(nth))


@named("INSTR")
def instr(s: Column, part: Column, at: Column | int | None = None, nth: Column | int | None = None) -> Column:
    """The place of a part, from 1; 0 if there is none. at: where to begin, from the end and backwards if below 0; nth: which
    occurrence. An empty part is found at 1."""
    start, times = _int(at, 1), _int(nth, 1)
    if start == 0 or times < 1:
        return F.when(s.isNotNull() & part.isNotNull(), F.when(part == "", 1).otherwise(0))
    forward = start > 0
    text, what = (s, part) if forward else (F.reverse(s), F.reverse(part))
    begin = F.lit(start) if forward else F.greatest(F.lit(1 - start) - F.length(part), F.lit(1))
    place = F.call_function("locate", what, text, begin)
    for _ in range(times - 1):
        place = F.when(place > 0, F.call_function("locate", what, text, place + 1)).otherwise(0)
    return F.when(part == "", 1).when(place == 0, 0).otherwise(place if forward else F.length(s) - place - F.length(part) + 2)


@named("REGEXP")
def regexp(p: Column, s: Column) -> Column:
    return F.rlike(s, compiled(p))


@named("REGEXP_LIKE")
def regexp_like(s: Column, p: Column, flags: Column | str | None = None) -> Column:
    return F.rlike(s, compiled(p, flags))


@named("REGEXP_SUBSTR")
def regexp_substr(s: Column, p: Column, at: Column | int | None = None, nth: Column | int | None = None, flags: Column | str | None = None, group: Column | int | None = None) -> Column:
    """The nth match from a place on, or one of its groups; null if there is none."""
    start, times = _int(at, 1), _int(nth, 1)
    if start < 1 or times < 1:
        return F.lit(None).cast("string")
    return F.try_element_at(F.regexp_extract_all(_rest(s, start), compiled(p, flags), F.lit(_int(group, 0))), F.lit(times))


@named("REGEXP_COUNT")
def regexp_count(s: Column, p: Column, at: Column | int | None = None, flags: Column | str | None = None) -> Column:
    return F.when(s.isNotNull() & p.isNotNull(), F.size(F.regexp_extract_all(_rest(s, _int(at, 1)), compiled(p, flags), F.lit(0))))


@named("REGEXP_INSTR")
def regexp_instr(s: Column, p: Column, at: Column | int | None = None, nth: Column | int | None = None, after: Column | int | None = None, flags: Column | str | None = None) -> Column:
    """Where the nth match from a place on starts (after 0) or what comes after it starts (after 1); 0 if there is none."""
    start, times = _int(at, 1), _int(nth, 1)
    if start < 1 or times < 1:
        return F.when(s.isNotNull() & p.isNotNull(), 0)
    place, found = _nth(_rest(s, start), compiled(p, flags), times)
    place = place + (F.length(found) if _int(after, 0) else F.lit(0)) + start - 1
    return F.when(s.isNotNull() & p.isNotNull(), F.coalesce(place, F.lit(0)))


@named("REGEXP_REPLACE")
def regexp_replace(s: Column, p: Column, to: Column | None = None, at: Column | int | None = None, nth: Column | int | None = None, flags: Column | str | None = None) -> Column:
    r"""Every match (nth 0) or the nth from a place on, replaced; \1 to \9 in the replacement are groups."""
    start, times = max(_int(at, 1), 1), _int(nth, 0)
    new = F.lit("") if to is None else F.regexp_replace(F.replace(to, F.lit("$"), F.lit(r"\$")), F.lit(r"\\(\d)"), F.lit(r"\$$1"))
    before = F.lit("") if start == 1 else F.substr(s, F.lit(1), F.lit(start - 1))
    rest, java = _rest(s, start), compiled(p, flags)
    if not times:
        return F.concat(before, F.regexp_replace(rest, java, new))
    place, found = _nth(rest, java, times)
    changed = F.concat(before, F.substr(rest, F.lit(1), place - 1), F.regexp_replace(found, java, new), F.substr(rest, place + F.length(found)))
    return F.when(place.isNull(), s).otherwise(changed)
