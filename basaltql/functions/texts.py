"""Number formats, escapes, XML, ranking and session functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from basaltql.functions.scalar import FUNCTIONS, _literal, named, xmlelement
from basaltql.operators.retrieval import K1, tokens


def fixed_digits(y: Column, places: int) -> tuple[Column, Column]:
    """The digits of a double that isn't negative before and after the point, as C prints them: its exact binary value is rounded,
    ties to even. Java's %.2f rounds the shortest decimal text, ties up. Exact below 2**125 and up to 16 places."""
    part = y % 1.0
    shown = F.format_number(part, places)
    whole = F.rint(y) if not places else y - part + F.when(F.startswith(shown, F.lit("1")), 1.0).otherwise(0.0)
    high = F.floor(whole / 2.0**62)
    large = high.cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)") + (whole - high * 2.0**62).try_cast("long").cast("decimal(19,0)")
    digits = F.when(whole < 2.0**63, whole.try_cast("long").cast("string")).when(whole < 2.0**125, large.cast("string")).otherwise(F.substring_index(F.format_string("%.1f", y), ".", 1))
    return digits, F.substring_index(shown, ".", -1)


def to_char_number(x: Column, model: str) -> Column:
    """TO_CHAR of a number: 9 and 0 for digits, `,` or G, `.` or D, and FM, S or MI for the sign. Compiled with the plan."""
    x = x.cast("double")
    m = model.upper()
    fill = not m.startswith("FM")
    m = m.removeprefix("FM")
    style = "MI" if m.endswith("MI") else "S-" if m.startswith("S") else "-S" if m.endswith("S") else ""
    whole, _, part = m.removesuffix("MI").strip("S").replace("G", ",").replace("D", ".").partition(".")
    width, places = len(re.findall("[90]", whole)), len(re.findall("[90]", part))
    digits, after = fixed_digits(F.abs(x), places)
    if "0" in whole:
        digits = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    if "," in whole:
        digits = F.regexp_replace(digits, r"\B(?=(\d{3})+$)", ",")
    if places:
        digits = F.concat(digits, F.lit("."), after)
    digits = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), "inf").otherwise(digits)
    #: A zero below zero has its sign, as in C.
    negative = (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))
    sign = lambda minus, plus: F.when(negative, minus).otherwise(plus)
    blank = " " if fill else ""
    out = {"MI": F.concat(digits, sign("-", blank)), "S-": F.concat(sign("-", "+"), digits), "-S": F.concat(digits, sign("-", "+")), "": F.concat(sign("-", blank), digits)}[style]
    return F.when(x.isNotNull(), out)


FUNCTIONS["TO_CHAR_NUMBER"] = to_char_number
for _n in ("TO_CLOB", "TO_NCLOB"):
    FUNCTIONS[_n] = lambda x: x.cast("string")


def _each(f):
    """A function of one text as an Arrow UDF; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in s], dtype=object)

    return run


def _units(text: str) -> str:
    """Characters beyond ASCII, and the backslash, as \\XXXX of their UTF-16 units."""
    data = text.encode("utf-16-be", "surrogatepass")
    units = [data[i] << 8 | data[i + 1] for i in range(0, len(data), 2)]
    return "".join(chr(u) if u < 128 else f"\\{u:04X}" for u in units)


def _characters(text: str) -> str:
    out = re.sub(r"\\([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), text)
    return out.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")


@named("ASCIISTR")
def asciistr(s: Column) -> Column:
    return _each(_units)(s)


@named("UNISTR")
def unistr(s: Column) -> Column:
    return _each(_characters)(s)


@named("DUMP")
def dump(x: Column) -> Column:
    """The value's UTF-8 bytes."""
    return _each(lambda s: f"Len={len(s.encode())}: {','.join(map(str, s.encode()))}")(x.cast("string"))


@named("ORA_HASH")
def ora_hash(x: Column, most: Column | None = None, seed: Column | None = None) -> Column:
    """The 32-bit FNV-1a hash of `value|seed`, modulo the number of buckets."""
    data = F.concat(x.cast("string"), F.lit("|"), (F.lit(0) if seed is None else seed).cast("int").cast("string"))
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(data, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda a, b: (a.bitwiseXOR(b) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF)))
    most = F.lit(0xFFFFFFFF) if most is None else most.cast("long")
    return F.when(most <= 0, F.when(x.isNotNull(), F.lit(0).cast("long"))).otherwise(h % (most + 1))


@named("RANDOMBLOB")
def randomblob(n: Column) -> Column:
    """n random bytes; one at least."""
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda _: F.lpad(F.hex(F.floor(F.rand() * 256).cast("long")), 2, "0")), ""))


@named("XMLFOREST")
def xmlforest(*pairs: Column) -> Column:
    """An element for each name and value in turn; null values are left out."""
    return F.concat_ws("", *(F.when(v.isNotNull(), xmlelement(n, v.cast("string"))) for n, v in zip(pairs[::2], pairs[1::2], strict=True)))


@named("XMLQUERY")
def xmlquery(expression: Column | str) -> Column:
    """Constant arithmetic only, by Spark's own parser."""
    text = _literal(expression) if isinstance(expression, Column) else expression
    if not re.fullmatch(r"[\d\s.+*/()-]+", text):
        raise ValueError("XMLQUERY takes constant arithmetic only")
    return F.expr(text)


def _same(term: str):
    """Whether a token is the term, or begins with it where it ends in a star."""
    return (lambda t: F.startswith(t, F.lit(term[:-1]))) if term.endswith("*") else (lambda t: t == term)


def _frequency(text: Column, query: str) -> Column:
    """How often the query's terms stand in the text: the sum over its words and prefixes."""
    out = F.lit(0)
    for term in re.findall(r"[A-Za-z0-9_]+\*?", query):
        if term.upper() not in ("AND", "OR", "NOT"):
            out = out + F.size(F.filter(tokens(text), _same(term.lower())))
    return out


@named("FTS5_TF")
def fts5_tf(text: Column, query: Column | str) -> Column:
    return F.when(text.isNull(), 0).otherwise(_frequency(text, _literal(query) if isinstance(query, Column) else query))


@named("BM25")
def bm25_single(text: Column, query: Column | str) -> Column:
    """Saturation of one document's term frequency, without corpus figures."""
    tf = fts5_tf(text, query).cast("double")
    return tf * (K1 + 1) / (tf + K1)


@named("GROUPING")
def grouping(x: Column) -> Column:
    return F.grouping(x)


@named("GROUPING_ID")
def grouping_id(*x: Column) -> Column:
    return F.grouping_id(*x)


@named("RAISE")
def raise_(action: Column, message: Column | None = None) -> Column:
    """Stops the query with the message; IGNORE gives null."""
    return F.when(F.upper(action) == "IGNORE", F.lit(None).cast("string")).otherwise(F.raise_error(message if message is not None else F.lit("")))


#: Parameters of the session context; others are UNKNOWN.
CONTEXT = {"SESSION_USER": "USER", "CURRENT_USER": "USER", "CURRENT_SCHEMA": "USER", "SCHEMAID": "USER", "DB_NAME": "FREEPDB1", "LANG": "US", "LANGUAGE": "AMERICAN_AMERICA.AL32UTF8", "SID": "1", "SESSIONID": "1", "ISDBA": "FALSE"}


@named("USERENV")
def userenv(parameter: Column | str) -> Column:
    return F.lit(CONTEXT.get((_literal(parameter) if isinstance(parameter, Column) else parameter).upper(), "UNKNOWN"))


@named("SYS_CONTEXT")
def sys_context(space: Column | str, parameter: Column | str) -> Column:
    return userenv(parameter)


FUNCTIONS["ROWID"] = F.monotonically_increasing_id
for _n, _v in {"LAST_INSERT_ROWID": 0, "CHANGES": 0, "TOTAL_CHANGES": 0, "SQLITE_SOURCE_ID": "basaltql"}.items():
    FUNCTIONS[_n] = lambda *_, v=_v: F.lit(v)
