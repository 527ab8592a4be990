"""The dialect's scalar functions as Column expressions, by name. Where a name's rule is Spark's own, Spark's function is used."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}


def named(*names: str):
    def add(f):
        for n in names:
            FUNCTIONS[n] = f
        return f

    return add


def call(name: str, *args) -> Column:
    """A function of the dialect. Strings name columns only as Columns; plain values are literals."""
    return FUNCTIONS[name.upper()](*(a if isinstance(a, Column) else F.lit(a) for a in args))


def _literal(c: Column) -> str:
    """The value of a literal Column, for formats that are compiled when the plan is made. Spark prints texts quoted."""
    shown = c._jc.toString()
    if len(shown) > 1 and shown[0] == shown[-1] == "'":
        return re.sub(r"\\(.)", r"\1", shown[1:-1])
    return shown


#: Names that mean the same in Spark SQL.
SAME = """UPPER LOWER LENGTH CHAR_LENGTH CHARACTER_LENGTH OCTET_LENGTH BIT_LENGTH LEFT RIGHT REVERSE REPEAT LPAD RPAD TRANSLATE
CONCAT_WS COALESCE NVL IFNULL NVL2 NULLIF NANVL ABS FLOOR CEIL CEILING POWER POW PI WIDTH_BUCKET CBRT EXP SIN COS TAN ATAN
ATAN2 SINH COSH TANH ASINH RADIANS DEGREES BIT_COUNT BASE64 CURRENT_TIMESTAMP CURRENT_DATE NOW LOCALTIMESTAMP CURDATE
UNIX_TIMESTAMP NEXT_DAY LAST_DAY YEAR MONTH DAY DAYOFMONTH HOUR MINUTE SECOND DAYOFWEEK WEEKDAY DAYOFYEAR DATEDIFF
MONTHS_BETWEEN""".split()
for _n in SAME:
    FUNCTIONS[_n] = lambda *a, n=_n: F.call_function(n, *a)
for _n, _to in {"LENGTHB": "octet_length", "NLSSORT": "upper", "NLS_UPPER": "upper", "NLS_LOWER": "lower", "HEXTORAW": "unhex", "RAWTOHEX": "hex", "BITAND": "bit_and_", "SYSDATE": "current_timestamp", "SYSTIMESTAMP": "current_timestamp", "UTC_TIMESTAMP": "current_timestamp", "UTC_DATE": "current_date", "UNIXEPOCH": "unix_timestamp"}.items():
    FUNCTIONS[_n] = lambda *a, n=_to: F.call_function(n, *a)
#: Hints and conversions that change nothing.
for _n in "COMPOSE TO_SINGLE_BYTE LIKELY UNLIKELY XMLSERIALIZE XMLTYPE NEW_TIME ROWIDTOCHAR CHARTOROWID".split():
    FUNCTIONS[_n] = lambda x, *_: x
FUNCTIONS["LIKELIHOOD"] = lambda x, *_: x
FUNCTIONS["BITAND"] = lambda a, b: a.bitwiseAND(b)
#: Session constants.
for _n, _v in {"GROUP_ID": 0, "SESSIONTIMEZONE": "+00:00", "DBTIMEZONE": "+00:00", "DATABASE": "main", "SCHEMA": "main", "SQLITE_VERSION": "3.45.0", "SQLITE_COMPILEOPTION_USED": 0, "SUBTYPE": 0, "VEC_TYPE": "float32", "LOAD_EXTENSION": None, "SQLITE_LOG": None, "SQLITE_COMPILEOPTION_GET": None, "SQLITE_OFFSET": None}.items():
    FUNCTIONS[_n] = lambda *_, v=_v: F.lit(v)


@named("CONCAT")
def concat(*a: Column) -> Column:
    """A null counts as empty."""
    return F.concat_ws("", *a)


@named("||")
def joined(a: Column, b: Column) -> Column:
    """A null counts as empty; null if nothing is left."""
    return F.nullif(F.concat_ws("", a, b), F.lit(""))


@named("SUBSTR", "SUBSTRING")
def substr(s: Column, start: Column, n: Column | None = None) -> Column:
    """From 1; a negative start counts from the end; start 0 takes one character off n; a negative n takes what is before."""
    size = F.length(s)
    at = F.when(start > 0, start).when(start < 0, size + start + 1).otherwise(F.lit(0))
    if n is None:
        return F.substr(s, F.greatest(at, F.lit(1)))
    lo = F.when(n >= 0, at).otherwise(at + n)
    hi = F.when(n >= 0, at + n).otherwise(at)
    lo1 = F.greatest(lo, F.lit(1))
    return F.when(s.isNull() | start.isNull() | n.isNull(), None).otherwise(F.substr(s, lo1, F.greatest(hi - lo1, F.lit(0))))


@named("POSITION")
def position(part: Column, s: Column) -> Column:
    return F.call_function("locate", part, s)


@named("TRIM")
def trim(s: Column, chars: Column | None = None) -> Column:
    return F.trim(s) if chars is None else F.call_function("btrim", s, chars)


@named("LTRIM")
def ltrim(s: Column, chars: Column | None = None) -> Column:
    return F.ltrim(s) if chars is None else F.call_function("ltrim", chars, s)


@named("RTRIM")
def rtrim(s: Column, chars: Column | None = None) -> Column:
    return F.rtrim(s) if chars is None else F.call_function("rtrim", chars, s)


@named("REPLACE")
def replace(s: Column, find: Column, to: Column | None = None) -> Column:
    return F.when(find == "", s).otherwise(F.replace(s, find, F.lit("") if to is None else to))


@named("OVERLAY")
def overlay(s: Column, new: Column, at: Column, n: Column | None = None) -> Column:
    return F.call_function("overlay", s, new, at, F.length(new) if n is None else n)


@named("ASCII", "UNICODE")
def ascii_(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.ascii(s))


@named("CHR", "NCHR", "CHAR")
def chr_(*codes: Column) -> Column:
    """Characters of code points, also beyond 255; nulls are left out."""
    one = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    return F.concat_ws("", *map(one, codes))


@named("SPACE")
def space(n: Column) -> Column:
    return F.repeat(F.lit(" "), n)


@named("INITCAP", "NLS_INITCAP")
def initcap(s: Column) -> Column:
    """A word starts after anything that is no letter or digit."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.substr(p, F.lit(2)))), "")


@named("SOUNDEX")
def soundex(s: Column) -> Column:
    return F.when(F.coalesce(s, F.lit("")) == "", "?000").otherwise(F.soundex(s))


@named("QUOTE")
def quote(s: Column) -> Column:
    return F.when(s.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(s.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")))


#: Conversions of PRINTF: Java's letter and the type of its argument.
CONVERSIONS = {"d": ("d", "long"), "i": ("d", "long"), "u": ("d", "long"), "x": ("x", "long"), "X": ("X", "long"), "o": ("o", "long"), "f": ("f", "double"), "e": ("e", "double"), "E": ("E", "double"), "g": ("g", "double"), "G": ("G", "double"), "p": ("X", "long"), "s": ("s", "string"), "z": ("s", "string")}


@named("PRINTF", "FORMAT")
def printf(form: Column | str, *a: Column) -> Column:
    """Texts by a format that is compiled with the plan: C's conversions, %q and %Q (quotes doubled, and a literal) and %c. A
    null is 0 or empty."""
    text, rest, out, args = _literal(form) if isinstance(form, Column) else form, list(a), [], []
    for plain, flags, kind in re.findall(r"([^%]+)|%([-+ 0#,]*\d*(?:\.\d+)?)(.)", text, re.DOTALL):
        if plain or kind == "%":
            out.append(plain or "%%")
            continue
        x = rest.pop(0) if rest else F.lit(None)
        if kind in "qQc":
            s = x.cast("string")
            x = {"q": lambda: F.replace(s, F.lit("'"), F.lit("''")), "Q": lambda: quote(x), "c": lambda: F.left(s, F.lit(1))}[kind]()
            kind = "s"
        java, wanted = CONVERSIONS.get(kind, ("s", "string"))
        out.append(f"%{flags}{java}")
        args.append(F.coalesce(x.try_cast(wanted) if wanted != "string" else x.cast(wanted), F.lit(0 if wanted != "string" else "").cast(wanted)))
    return F.format_string("".join(out), *args) if args else F.lit("".join(out).replace("%%", "%"))


@named("SUBSTRB")
def substrb(s: Column, start: Column, n: Column | None = None) -> Column:
    b = s.cast("binary")
    at = F.when(start < 0, F.octet_length(s) + start + 1).otherwise(start)
    return F.decode(F.substr(b, at) if n is None else F.substr(b, at, n), "UTF-8")


@named("INSTRB")
def instrb(s: Column, part: Column) -> Column:
    at = F.call_function("instr", s, part)
    return F.when(at == 0, 0).otherwise(F.octet_length(F.substr(s, F.lit(1), at - 1)) + 1)


@named("GLOB")
def glob(s: Column, p: Column) -> Column:
    """* any run, ? any character, [..] a set."""
    quoted = F.regexp_replace(p, F.lit(r"([.+(){}^$|\\])"), F.lit(r"\\$1"))
    return F.rlike(s, F.concat(F.lit("^(?s)"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$")))


def _any_null(a: tuple[Column, ...]) -> Column:
    out = F.lit(False)
    for c in a:
        out = out | c.isNull()
    return out


@named("LEAST")
def least(*a: Column) -> Column:
    return F.when(~_any_null(a), F.least(*a))


@named("GREATEST")
def greatest(*a: Column) -> Column:
    return F.when(~_any_null(a), F.greatest(*a))


@named("DECODE")
def decode(e: Column, *rest: Column) -> Column:
    """Search and result pairs; a null finds a null; a last single value is the default."""
    out = rest[-1] if len(rest) % 2 else F.lit(None)
    for i in range(len(rest) - len(rest) % 2 - 2, -1, -2):
        out = F.when(e.eqNullSafe(rest[i]), rest[i + 1]).otherwise(out)
    return out


@named("IIF")
def iif(c: Column, a: Column, b: Column) -> Column:
    return F.when(c, a).otherwise(b)


@named("LNNVL")
def lnnvl(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


@named("TYPEOF")
def typeof(x: Column) -> Column:
    kind = F.typeof(x)
    return F.when(x.isNull(), "null").when(kind.isin("double", "float") | kind.startswith("decimal"), "real").when(kind == "string", "text").when(kind == "binary", "blob").otherwise("integer")


@named("MOD")
def mod(n: Column, m: Column) -> Column:
    return F.when(m == 0, n).otherwise(F.try_mod(n, m))


@named("%")
def remainder_operator(n: Column, m: Column) -> Column:
    return F.try_mod(n, m)


@named("/")
def divide(n: Column, m: Column) -> Column:
    return F.try_divide(n.cast("double"), m.cast("double"))


FUNCTIONS["+"] = lambda a, b: a + b
FUNCTIONS["-"] = lambda a, b: a - b
FUNCTIONS["*"] = lambda a, b: a * b
FUNCTIONS["&"] = lambda a, b: a.bitwiseAND(b)
FUNCTIONS["|"] = lambda a, b: a.bitwiseOR(b)
FUNCTIONS["~"] = lambda a: F.bitwise_not(a)
FUNCTIONS["<<"] = lambda a, n: F.call_function("shiftleft", a.cast("long"), n.cast("int"))
FUNCTIONS[">>"] = lambda a, n: F.call_function("shiftright", a.cast("long"), n.cast("int"))


@named("REMAINDER")
def remainder(n: Column, m: Column) -> Column:
    return n - m * F.bround(F.try_divide(n.cast("double"), m.cast("double")))


@named("SQRT")
def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


@named("SIGN")
def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


@named("LN")
def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


@named("LOG10")
def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


@named("LOG2")
def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


@named("LOG")
def log(a: Column, b: Column | None = None) -> Column:
    """LOG(x) has base 10; LOG(base, x)."""
    return log10(a) if b is None else F.try_divide(ln(b), ln(a))


@named("COT")
def cot(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), F.tan(x))


@named("ACOT")
def acot(x: Column) -> Column:
    return F.when(x == 0, F.pi() / 2).otherwise(F.atan(F.try_divide(F.lit(1.0), x)))


@named("ASIN")
def asin(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.asin(x))


@named("ACOS")
def acos(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.acos(x))


@named("ACOSH")
def acosh(x: Column) -> Column:
    return F.when(x >= 1, F.acosh(x))


@named("ATANH")
def atanh(x: Column) -> Column:
    return F.when(F.abs(x) < 1, F.atanh(x))


@named("BIN_TO_NUM")
def bin_to_num(*bits: Column) -> Column:
    out = F.lit(0).cast("long")
    for b in bits:
        out = out * 2 + b
    return out


@named("RANDOM")
def random() -> Column:
    return (F.rand() * 2**31).cast("int")


@named("STANDARD_HASH")
def standard_hash(x: Column, kind: Column | str = "SHA1") -> Column:
    """SHA1, MD5, SHA256, SHA384 or SHA512 in upper-case hexadecimal."""
    name = (_literal(kind) if isinstance(kind, Column) else kind).upper()
    data = x.cast("binary")
    return F.upper(F.sha1(data) if name == "SHA1" else F.md5(data) if name == "MD5" else F.sha2(data, int(name[3:])))


@named("HEX")
def hex_(x: Column) -> Column:
    return F.hex(x.cast("binary"))


@named("UNHEX")
def unhex(x: Column) -> Column:
    return F.when((F.length(x) % 2 == 0) & F.rlike(x, F.lit("^[0-9A-Fa-f]*$")), F.unhex(x))


@named("UNBASE64")
def unbase64(x: Column) -> Column:
    return F.try_to_binary(x, F.lit("base64"))


@named("ZEROBLOB")
def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n))


@named("UTL_RAW.CAST_TO_RAW")
def cast_to_raw(x: Column) -> Column:
    return x.cast("binary")


@named("UTL_RAW.CAST_TO_VARCHAR2")
def cast_to_varchar2(x: Column) -> Column:
    return F.decode(x, "UTF-8")


@named("VSIZE")
def vsize(x: Column) -> Column:
    """Bytes of a text; of a number one more than half of its significant digits."""
    s = x.cast("string")
    digits = F.length(F.regexp_replace(F.regexp_replace(s, r"[-.]", ""), r"^0+(?=[0-9])|0+$", ""))
    numeric = F.typeof(x).rlike("int|double|float|decimal")
    return F.when(numeric, F.ceil(F.greatest(digits, F.lit(1)) / 2).cast("int") + 1).otherwise(F.octet_length(s))


@named("SYS_GUID")
def sys_guid() -> Column:
    return F.upper(F.replace(F.uuid(), F.lit("-"), F.lit("")))


@named("ADD_MONTHS")
def add_months(d: Column, n: Column) -> Column:
    """The last day of a month stays the last day."""
    return F.when(d.cast("date") == F.last_day(d), F.last_day(F.add_months(d, n))).otherwise(F.add_months(d, n))


@named("DAYNAME")
def dayname(d: Column) -> Column:
    return F.date_format(d, "EEEE")


@named("MONTHNAME")
def monthname(d: Column) -> Column:
    return F.date_format(d, "MMMM")


@named("MICROSECOND")
def microsecond(t: Column) -> Column:
    return F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000))


@named("__OVERLAPS")
def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


@named("JSON", "JSONB")
def json(x: Column) -> Column:
    return F.to_json(F.try_parse_json(x))


@named("JSON_VALID", "JSONB_VALID")
def json_valid(x: Column) -> Column:
    """1 for one whole JSON value. Spark's parser skips what follows a value, so the text must also stand as an item and as a member."""
    item, member = F.concat(F.lit("["), x, F.lit("]")), F.concat(F.lit('{"v":'), x, F.lit("}"))
    return F.when(x.isNotNull(), (F.try_parse_json(item).isNotNull() & F.try_parse_json(member).isNotNull()).cast("int"))


@named("JSON_ARRAY_LENGTH", "JSONB_ARRAY_LENGTH")
def json_array_length(x: Column) -> Column:
    return F.coalesce(F.json_array_length(x), F.lit(0))


@named("XMLELEMENT")
def xmlelement(name: Column, content: Column) -> Column:
    return F.concat(F.lit("<"), name, F.lit(">"), content, F.lit("</"), name, F.lit(">"))


@named("EXTRACTVALUE")
def extractvalue(x: Column, path: Column) -> Column:
    return F.xpath_string(x, path)


@named("RRF_SCORE")
def rrf_score(rank: Column) -> Column:
    return F.when(rank.isNull(), 0.0).otherwise(1 / (60 + rank))


@named("HYBRID_SCORE")
def hybrid_score(distance: Column, fts: Column, alpha: Column) -> Column:
    return alpha / (1 + distance) + (1 - alpha) * fts
