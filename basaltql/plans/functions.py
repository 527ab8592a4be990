"""A query for each scalar function that the other modules have none for, all through `call`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basaltql.functions.formats import cast
from basaltql.functions.scalar import call
from basaltql.plans.catalogue import scalar, t
from basaltql.plans.registry import query

c = F.col
N, B, S, D, P, V = "c_name", "c_acctbal", "p_size", "o_orderdate", "props", "embedding"


def made(name: str, *args, digits: int | None = None, shown: str | None = None):
    """The column of a call: rounded, or as text by a date pattern."""

    def column() -> Column:
        v = call(name, *(a() if callable(a) else a for a in args))
        v = F.round(v, digits) if digits is not None else v
        return F.date_format(v, shown) if shown else v

    return column


def rows(table: str, key: str, *entries: tuple) -> None:
    """(label, call, SQL) each; labels in brackets tell calls of one function apart."""
    for label, column, oracle in entries:
        scalar(label, table, key, column, oracle)


col = lambda n: lambda: c(n)
none = lambda kind="string": lambda: F.lit(None).cast(kind)
unit = lambda: c(B) / 20000  # noqa: E731  within -1 and 1
U_SQL = "(c_acctbal / 20000)"
named_text = lambda: F.concat(c(N), F.lit(" o'neil"))

rows("customer", "c_custkey",
    ("CHAR_LENGTH", made("CHAR_LENGTH", col(N)), "length(c_name)"),
    ("CHARACTER_LENGTH", made("CHARACTER_LENGTH", col(N)), "length(c_name)"),
    ("BIT_LENGTH", made("BIT_LENGTH", col(N)), "8 * strlen(c_name)"),
    ("LENGTHB", made("LENGTHB", lambda: F.concat(c(N), F.lit("é"))), "strlen(c_name || 'é')"),
    ("SUBSTRB", made("SUBSTRB", col(N), 3, 4), "substr(c_name, 3, 4)"),
    ("INSTRB", made("INSTRB", lambda: F.concat(F.lit("é"), c(N)), "#"), "instr(c_name, '#') + 2"),
    ("LTRIM", made("LTRIM", col(N), "Cu"), "ltrim(c_name, 'Cu')"),
    ("SUBSTRING", made("SUBSTRING", col(N), -4, 2), "substr(c_name, -4, 2)"),
    ("POSITION", made("POSITION", "#", col(N)), "instr(c_name, '#')"),
    ("OVERLAY", made("OVERLAY", col(N), "XX", 3, 4), "c_name[1:2] || 'XX' || c_name[7:]"),
    ("CHR", made("CHR", lambda: c("c_custkey") % 500 + 8364), "chr(CAST(c_custkey % 500 + 8364 AS INT))"),
    ("NCHR", made("NCHR", lambda: c("c_custkey") % 26 + 65), "chr(CAST(c_custkey % 26 + 65 AS INT))"),
    ("CHAR", made("CHAR", 65, lambda: c("c_custkey") % 26 + 97, none("int")), "'A' || chr(CAST(c_custkey % 26 + 97 AS INT))"),
    ("NLSSORT", made("NLSSORT", col(N)), "upper(c_name)"),
    ("COMPOSE", made("COMPOSE", col(N)), "c_name"),
    ("TO_SINGLE_BYTE", made("TO_SINGLE_BYTE", col(N)), "c_name"),
    ("SPACE", made("SPACE", lambda: c("c_custkey") % 4), "repeat(' ', CAST(c_custkey % 4 AS INT))"),
    ("CONCAT_WS", made("CONCAT_WS", "-", col(N), none(), "z"), "c_name || '-z'"),
    ("SOUNDEX", made("SOUNDEX", lambda: F.when(c("c_custkey") % 2 == 0, "Robert").when(c("c_custkey") % 3 == 0, "Tymczak")), "CASE WHEN c_custkey % 2 = 0 THEN 'R163' WHEN c_custkey % 3 = 0 THEN 'T522' ELSE '?000' END"),
    ("UNICODE", made("UNICODE", lambda: F.concat(F.lit("漢"), c(N))), "28450"),
    ("PRINTF", made("PRINTF", "%05d|%.2f|%s|%q|%x|%c", col("c_custkey"), col(B), col(N), "it's", col("c_custkey"), col(N)), "printf('%05d', c_custkey) || '|' || printf('%.2f', c_acctbal) || '|' || c_name || '|it''''s|' || printf('%x', c_custkey) || '|C'"),
    ("FORMAT", made("FORMAT", "%i%%-%Q", col("c_custkey"), none()), "c_custkey || '%-NULL'"),
    ("NLS_UPPER", made("NLS_UPPER", col(N)), "upper(c_name)"),
    ("NLS_LOWER", made("NLS_LOWER", col(N)), "lower(c_name)"),
    ("NLS_INITCAP", made("NLS_INITCAP", named_text), "'Customer' || c_name[9:] || ' O''Neil'"),
    ("INSTR_NTH", made("INSTR", col(N), "0", 1, 3), "CASE WHEN length(c_name) - length(replace(c_name, '0', '')) >= 3 THEN list_filter(range(1, length(c_name) + 1), lambda i: c_name[i] = '0')[3] ELSE 0 END"),
    ("INSTR_BACK", made("INSTR", col(N), "0", -2, 2), "coalesce(list_reverse(list_filter(range(1, length(c_name)), lambda i: c_name[i] = '0'))[2], 0)"),
    ("REGEXP", made("REGEXP", "7$", col(N)), "regexp_matches(c_name, '7$')"),
    ("REGEXP_COUNT", made("REGEXP_COUNT", col(N), "0+", 12), "len(regexp_extract_all(c_name[12:], '0+'))"),
    ("REGEXP_INSTR", made("REGEXP_INSTR", col(N), "[[:digit:]]", 1, 3, 1), "13"),
    ("REGEXP_INSTR_NONE", made("REGEXP_INSTR", col(N), "9", 1, 2), "coalesce(list_filter(range(1, length(c_name) + 1), lambda i: c_name[i] = '9')[2], 0)"),
    ("REGEXP_LIKE_FLAGS", made("REGEXP_LIKE", col(N), "CUSTOMER.*5", "i"), "regexp_matches(c_name, 'CUSTOMER.*5', 'i')"),
    ("REGEXP_SUBSTR_GROUP", made("REGEXP_SUBSTR", col(N), "(0)([1-9])", 1, 1, "c", 2), "nullif(regexp_extract(c_name, '0([1-9])', 1), '')"),
    ("REGEXP_REPLACE_NTH", made("REGEXP_REPLACE", col(N), "([0-9])([0-9])", r"\2$\1", 10, 2), "c_name[1:11] || c_name[13:13] || '$' || c_name[12:12] || c_name[14:]"),
    ("COALESCE", made("COALESCE", none(), col(N), "x"), "c_name"),
    ("IFNULL", made("IFNULL", lambda: F.nullif(c("c_nationkey"), F.lit(3)), -1), "CASE WHEN c_nationkey = 3 THEN -1 ELSE c_nationkey END"),
    ("NVL", made("NVL", lambda: F.nullif(c("c_nationkey"), F.lit(4)), -2), "CASE WHEN c_nationkey = 4 THEN -2 ELSE c_nationkey END"),
    ("NULLIF", made("NULLIF", col("c_mktsegment"), "BUILDING"), "nullif(c_mktsegment, 'BUILDING')"),
    ("IIF", made("IIF", lambda: c(B) < 0, "debt", "credit"), "CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END"),
    ("LNNVL", made("LNNVL", lambda: F.nullif(c("c_nationkey"), F.lit(3)) > 10), "c_nationkey = 3 OR NOT c_nationkey > 10"),
    ("NANVL", made("NANVL", lambda: F.when(c("c_custkey") % 2 == 0, F.lit(float("nan"))).otherwise(c(B)), 1.5), "CASE WHEN c_custkey % 2 = 0 THEN 1.5 ELSE c_acctbal END"),
    ("LIKELY", made("LIKELY", lambda: c(B) > 0), "c_acctbal > 0"),
    ("UNLIKELY", made("UNLIKELY", lambda: c(B) > 0), "c_acctbal > 0"),
    ("LIKELIHOOD", made("LIKELIHOOD", lambda: c(B) > 0, 0.9), "c_acctbal > 0"),
    ("TYPEOF_REAL", made("TYPEOF", col(B)), "'real'"),
    ("ROUND", made("ROUND", col(B), 1), "round(c_acctbal, 1)"),
    ("REMAINDER", made("REMAINDER", lambda: c("c_custkey") % 11, 4, digits=6), "(c_custkey % 11) - 4 * round_even((c_custkey % 11) / 4.0, 0)"),
    ("CEILING", made("CEILING", col(B)), "CAST(ceil(c_acctbal) AS BIGINT)"),
    ("POWER", made("POWER", unit, 3, digits=9), f"round(pow({U_SQL}, 3), 9)"),
    ("POW", made("POW", unit, 2, digits=9), f"round(pow({U_SQL}, 2), 9)"),
    ("PI", made("PI", digits=9), "round(pi(), 9)"),
    ("WIDTH_BUCKET", made("WIDTH_BUCKET", col(B), 0.0, 10000.0, 8), "CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal >= 10000 THEN 9 ELSE CAST(floor(c_acctbal / 1250) AS BIGINT) + 1 END"),
    ("EXP", made("EXP", unit, digits=9), f"round(exp({U_SQL}), 9)"),
    ("LOG10", made("LOG10", col(B), digits=9), "CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 9) END"),
    ("LOG_BASE", made("LOG", 3, lambda: c(B).cast("double"), digits=8), "CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal) / ln(3), 8) END"),
    ("TAN", made("TAN", unit, digits=9), f"round(tan({U_SQL}), 9)"),
    ("COT", made("COT", lambda: unit() + 1, digits=8), f"round(cot({U_SQL} + 1), 8)"),
    ("ACOT", made("ACOT", lambda: unit() + 1, digits=9), f"round(atan(1 / ({U_SQL} + 1)), 9)"),
    ("ACOS", made("ACOS", lambda: unit() * 3, digits=9), f"CASE WHEN abs({U_SQL} * 3) <= 1 THEN round(acos({U_SQL} * 3), 9) END"),
    ("ATAN2", made("ATAN2", unit, 0.5, digits=9), f"round(atan2({U_SQL}, 0.5), 9)"),
    ("SINH", made("SINH", unit, digits=9), f"round(sinh({U_SQL}), 9)"),
    ("COSH", made("COSH", unit, digits=9), f"round(cosh({U_SQL}), 9)"),
    ("TANH", made("TANH", unit, digits=9), f"round(tanh({U_SQL}), 9)"),
    ("ASINH", made("ASINH", unit, digits=9), f"round(asinh({U_SQL}), 9)"),
    ("ACOSH", made("ACOSH", lambda: unit() + 1, digits=7), f"CASE WHEN {U_SQL} >= 0 THEN round(acosh({U_SQL} + 1), 7) END"),
    ("ATANH", made("ATANH", lambda: unit() * 3, digits=8), f"CASE WHEN abs({U_SQL} * 3) < 1 THEN round(atanh({U_SQL} * 3), 8) END"),
    ("TRUNC_PLACES", made("TRUNC", col(B), 1, digits=4), "round(sign(c_acctbal) * floor(abs(c_acctbal) * 10) / 10, 4)"),
    ("RANDOM", lambda: call("RANDOM").between(0, 2**31 - 1), "true"),
    ("BIN_TO_NUM", made("BIN_TO_NUM", 1, 0, lambda: c("c_custkey") % 2), "4 + c_custkey % 2"),
    ("UNHEX", made("UNHEX", lambda: F.hex(c(N)).cast("string")), "CAST(c_name AS BLOB)"),
    ("UNHEX_ODD", made("UNHEX", lambda: F.concat(F.hex(c(N)), F.lit("1"))), "CAST(NULL AS BLOB)"),
    ("BASE64", made("BASE64", lambda: c(N).cast("binary")), "to_base64(CAST(c_name AS BLOB))"),
    ("UNBASE64", made("UNBASE64", lambda: F.base64(c(N).cast("binary"))), "CAST(c_name AS BLOB)"),
    ("ZEROBLOB", lambda: F.hex(call("ZEROBLOB", 3)), "'000000'"),
    ("RANDOMBLOB", lambda: F.length(call("RANDOMBLOB", 5)), "5"),
    ("HEXTORAW", made("HEXTORAW", lambda: F.hex(c(N))), "CAST(c_name AS BLOB)"),
    ("RAWTOHEX", made("RAWTOHEX", col(N)), "hex(c_name)"),
    ("UTL_RAW.CAST_TO_RAW", made("UTL_RAW.CAST_TO_RAW", col(N)), "CAST(c_name AS BLOB)"),
    ("UTL_RAW.CAST_TO_VARCHAR2", made("UTL_RAW.CAST_TO_VARCHAR2", lambda: c(N).cast("binary")), "c_name"),
    ("VSIZE", made("VSIZE", col(N)), "strlen(c_name)"),
    ("VSIZE_NUMBER", made("VSIZE", col("c_nationkey")), "CASE WHEN c_nationkey % 10 = 0 OR c_nationkey < 10 THEN 2 ELSE 2 END"),
    ("SYS_GUID", lambda: call("SYS_GUID").rlike("^[0-9A-F]{32}$"), "true"),
    ("STANDARD_HASH_SHA256", made("STANDARD_HASH", col(N), "SHA256"), "upper(sha256(c_name))"),
    ("TO_BINARY_FLOAT", made("TO_BINARY_FLOAT", lambda: c("c_custkey").cast("string")), "CAST(c_custkey AS FLOAT)"),
    ("TO_BINARY_DOUBLE", made("TO_BINARY_DOUBLE", lambda: c(B).cast("string")), "CAST(c_acctbal AS DOUBLE)"),
    ("TO_CLOB", made("TO_CLOB", col("c_custkey")), "CAST(c_custkey AS VARCHAR)"),
    ("TO_NCLOB", made("TO_NCLOB", col(N)), "c_name"),
    ("TO_NUMBER", made("TO_NUMBER", lambda: F.when(c("c_custkey") % 2 == 0, c("c_custkey").cast("string")).otherwise("x1")), "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS DOUBLE) END"),
    ("TO_NUMBER_MODEL", made("TO_NUMBER", lambda: F.concat(F.lit("$"), F.format_number(c("c_custkey") * 1000, 2)), "$9,999,999.99"), "CAST(c_custkey * 1000 AS DOUBLE)"),
    ("TO_CHAR_MODEL", made("TO_CHAR", lambda: c("c_custkey") * 1000, "FM99,999,999,999"), "format('{:,}', c_custkey * 1000)"),
    ("ROWIDTOCHAR", made("ROWIDTOCHAR", col(N)), "c_name"),
    ("CHARTOROWID", made("CHARTOROWID", col(N)), "c_name"),
    ("ROWID", lambda: call("ROWID") >= 0, "true"),
    ("SYS_CONTEXT", made("SYS_CONTEXT", "USERENV", "SESSION_USER"), "'USER'"),
    ("USERENV", made("USERENV", "LANG"), "'US'"),
    ("RAISE", made("RAISE", "IGNORE"), "CAST(NULL AS VARCHAR)"),
    ("LOAD_EXTENSION", lambda: call("LOAD_EXTENSION", "x").isNull(), "true"),
    ("SQLITE_LOG", lambda: call("SQLITE_LOG", 1, "x").isNull(), "true"),
    ("SQLITE_COMPILEOPTION_GET", lambda: call("SQLITE_COMPILEOPTION_GET", 0).isNull(), "true"),
    ("SQLITE_OFFSET", lambda: call("SQLITE_OFFSET", 0).isNull(), "true"),
    ("DATABASE", made("DATABASE"), "'main'"), ("SCHEMA", made("SCHEMA"), "'main'"),
    ("SQLITE_VERSION", made("SQLITE_VERSION"), "'3.45.0'"),
    ("SQLITE_SOURCE_ID", lambda: F.length(call("SQLITE_SOURCE_ID")) > 0, "true"),
    ("SQLITE_COMPILEOPTION_USED", made("SQLITE_COMPILEOPTION_USED", "x"), "0"), ("SUBTYPE", made("SUBTYPE", col(N)), "0"), ("GROUP_ID", made("GROUP_ID"), "0"),
    ("SESSIONTIMEZONE", made("SESSIONTIMEZONE"), "'+00:00'"), ("DBTIMEZONE", made("DBTIMEZONE"), "'+00:00'"),
    ("XMLELEMENT", made("XMLELEMENT", "n", col(N)), "'<n>' || c_name || '</n>'"),
    ("XMLQUERY", made("XMLQUERY", "(1 + 2) * 4"), "12"),
    ("XMLSERIALIZE", made("XMLSERIALIZE", lambda: F.concat(F.lit("<a>"), c(N), F.lit("</a>"))), "'<a>' || c_name || '</a>'"),
    ("XMLTYPE", made("XMLTYPE", lambda: F.concat(F.lit("<a>"), c(N), F.lit("</a>"))), "'<a>' || c_name || '</a>'"),
    ("EXTRACTVALUE", made("EXTRACTVALUE", lambda: F.concat(F.lit("<a><b>"), c(N), F.lit("</b></a>")), "/a/b"), "c_name"),
    ("RRF_SCORE", made("RRF_SCORE", col("c_custkey"), digits=9), "round(1.0 / (60 + c_custkey), 9)"),
    ("RRF", made("RRF", col("c_custkey"), none("int"), 2, digits=9), "round(1.0 / (60 + c_custkey) + 1.0 / 62, 9)"),
    ("HYBRID_SCORE", made("HYBRID_SCORE", lambda: c("c_custkey").cast("double"), 0.5, 0.25, digits=9), "round(0.25 / (1 + c_custkey) + 0.75 * 0.5, 9)"),
    ("JSON_QUOTE_NUMBER", made("JSON_QUOTE", col("c_custkey")), "CAST(c_custkey AS VARCHAR)"),
    ("DIVIDE", made("/", col("c_custkey"), lambda: c("c_custkey") % 3), "CASE WHEN c_custkey % 3 <> 0 THEN c_custkey / (c_custkey % 3) END"),
    ("REMAINDER_OPERATOR", made("%", col("c_custkey"), lambda: c("c_custkey") % 3), "CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % (c_custkey % 3) END"),
    ("CONCAT_OPERATOR", made("||", col(N), none()), "c_name"),
    ("PLUS_MINUS_TIMES", lambda: call("-", call("+", c("c_custkey"), call("*", c("c_custkey"), 3)), 1), "c_custkey + c_custkey * 3 - 1"),
    ("SHIFT_LEFT", made("<<", col("c_custkey"), 3), "c_custkey * 8"), ("SHIFT_RIGHT", made(">>", col("c_custkey"), 2), "c_custkey // 4"), ("BIT_NOT", made("~", col("c_custkey")), "-c_custkey - 1"),
    ("CAST_NUMBER", lambda: cast(c(B), "NUMBER(12,1)"), "CAST(round(c_acctbal, 1) AS DECIMAL(12,1))"),
    ("CAST_VARCHAR2", lambda: cast(c(N), "VARCHAR2(5)"), "c_name[1:5]"),
)

stamp = "strftime({}, '%Y-%m-%d %H:%M:%S')".format
shown = "yyyy-MM-dd HH:mm:ss"
odd = lambda: c(D) + F.make_dt_interval(hours=c("o_orderkey") % 24, mins=c("o_orderkey") % 60, secs=c("o_orderkey") % 59)
ODD = "(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) + to_minutes(CAST(o_orderkey % 60 AS INT)) + to_seconds(o_orderkey % 59))"
text = lambda pattern: lambda: F.date_format(c(D), pattern)
recent = lambda name: lambda: call(name).cast("timestamp") > F.lit("2020-01-01")

rows("orders", "o_orderkey",
    *((n, recent(n), "true") for n in ("CURRENT_TIMESTAMP", "CURRENT_DATE", "NOW", "SYSDATE", "SYSTIMESTAMP", "LOCALTIMESTAMP", "CURDATE", "UTC_TIMESTAMP", "UTC_DATE")),
    *((n, lambda n=n: call(n).rlike("^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$"), "true") for n in ("CURRENT_TIME", "CURTIME", "UTC_TIME")),
    ("DATE_JULIAN", made("DATE", lambda: F.datediff(c(D), F.lit("1970-01-01").cast("date")) + 2440588), "strftime(o_orderdate, '%Y-%m-%d')"),
    ("TIMEDIFF", made("TIMEDIFF", lambda: odd(), col(D)), "printf('+0000-00-00 %02d:%02d:%02d.000', CAST(o_orderkey % 24 + (o_orderkey % 60 * 60 + o_orderkey % 59) // 3600 AS INT), CAST((o_orderkey % 60 * 60 + o_orderkey % 59) // 60 % 60 AS INT), CAST(o_orderkey % 59 AS INT))"),
    ("JULIANDAY_MODIFIED", made("JULIANDAY", col(D), "+1 day", digits=6), "round(epoch(o_orderdate) / 86400.0 + 2440588.5, 6)"),
    ("UNIXEPOCH", made("UNIXEPOCH", col(D)), "CAST(epoch(o_orderdate) AS BIGINT)"),
    ("UNIX_TIMESTAMP", made("UNIX_TIMESTAMP", col(D)), "CAST(epoch(o_orderdate) AS BIGINT)"),
    ("TO_DATE", made("TO_DATE", text("dd.MM.yyyy"), "DD.MM.YYYY", shown="yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')"),
    ("TO_DATE_RR", made("TO_DATE", text("yyMMdd"), "RRMMDD", shown="yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')"),
    ("TO_DATE_DDD", made("TO_DATE", text("yyyy/D"), "YYYY/DDD", shown="yyyy-MM-dd"), "strftime(o_orderdate, '%Y-%m-%d')"),
    ("TO_TIMESTAMP", made("TO_TIMESTAMP", lambda: F.date_format(odd(), "dd-MMM-yyyy HH:mm:ss"), "DD-MON-YYYY HH24:MI:SS", shown=shown), stamp(ODD)),
    ("TO_TIMESTAMP_TZ", made("TO_TIMESTAMP_TZ", lambda: F.concat(F.date_format(odd(), shown), F.lit(" +05:30")), "YYYY-MM-DD HH24:MI:SS TZH:TZM", shown=shown), stamp(ODD)),
    ("STR_TO_DATE", made("STR_TO_DATE", lambda: F.date_format(odd(), shown), "%Y-%m-%d", shown=shown), stamp(ODD)),
    ("TO_CHAR_ELEMENTS", made("TO_CHAR", lambda: odd(), 'DY DDMONYYYY "of" Day HH12:MI AM Q WW W DDD J D SSSSS RM'), f"upper(strftime({ODD}, '%a %d%b%Y')) || ' of ' || strftime({ODD}, '%A %I:%M %p ') || quarter(o_orderdate) || ' ' || printf('%02d', CAST(ceil(dayofyear({ODD}) / 7.0) AS INT)) || ' ' || CAST(ceil(day({ODD}) / 7.0) AS INT) || ' ' || printf('%03d', CAST(dayofyear({ODD}) AS INT)) || ' ' || CAST(epoch(date_trunc('day', {ODD})) / 86400 + 2440588 AS BIGINT) || ' ' || (dayofweek({ODD}) + 1) || ' ' || CAST(epoch({ODD}) % 86400 AS BIGINT) || ' ' || ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII'][month({ODD})]"),
    ("STRFTIME_CODES", made("STRFTIME", "%e %j %w %W %s %p %H%%", lambda: odd()), f"lpad(CAST(day({ODD}) AS VARCHAR), 2, ' ') || strftime({ODD}, ' %j %w %W ') || CAST(epoch({ODD}) AS BIGINT) || strftime({ODD}, ' %p %H') || '%'"),
    ("DATE_FORMAT", made("DATE_FORMAT", lambda: odd(), "%M %e, %Y %H:%i:%s %a"), f"strftime({ODD}, '%B ') || day({ODD}) || strftime({ODD}, ', %Y %H:%M:%S %a')"),
    ("TIME_FORMAT", made("TIME_FORMAT", lambda: odd(), "%h.%i %p"), f"strftime({ODD}, '%I.%M %p')"),
    ("FROM_UNIXTIME_FORMAT", made("FROM_UNIXTIME", lambda: F.unix_seconds(odd().cast("timestamp")), "%d/%c/%y"), f"strftime({ODD}, '%d/') || month({ODD}) || strftime({ODD}, '/%y')"),
    *((f"TRUNC_{u}", made("TRUNC", lambda: odd(), u, shown=shown), stamp(f"date_trunc('{w}', {ODD})")) for u, w in {"YYYY": "year", "Q": "quarter", "MM": "month", "IW": "week", "DD": "day", "HH24": "hour", "MI": "minute"}.items()),
    ("TRUNC_DAY", made("TRUNC", lambda: odd(), "DAY", shown=shown), stamp(f"date_trunc('day', {ODD}) - to_days(CAST(dayofweek({ODD}) AS INT))")),
    ("ROUND_YYYY", made("ROUND", lambda: odd(), "YYYY", shown=shown), stamp(f"date_trunc('year', {ODD}) + to_years(CAST(month({ODD}) >= 7 AS INT))")),
    ("ROUND_MM", made("ROUND", lambda: odd(), "MM", shown=shown), stamp(f"date_trunc('month', {ODD}) + to_months(CAST(day({ODD}) >= 16 AS INT))")),
    ("ROUND_DD", made("ROUND", lambda: odd(), "DD", shown=shown), stamp(f"date_trunc('day', {ODD} + INTERVAL 12 HOUR)")),
    ("TZ_OFFSET", made("TZ_OFFSET", "-03:00"), "'-03:00'"),
    ("NEW_TIME", made("NEW_TIME", col(D), "AST", "PST", shown=shown), stamp("o_orderdate")),
    ("TO_YMINTERVAL", made("TO_YMINTERVAL", "1-2"), "425"),
    ("TO_DSINTERVAL", made("TO_DSINTERVAL", "2 12:00:00"), "2.5"),
    ("NUMTODSINTERVAL", made("NUMTODSINTERVAL", lambda: c("o_orderkey") % 100, "HOUR", digits=9), "round((o_orderkey % 100) / 24.0, 9)"),
    ("ADD_MONTHS", made("ADD_MONTHS", col(D), 1, shown="yyyy-MM-dd"), "strftime(CASE WHEN CAST(o_orderdate AS DATE) = last_day(o_orderdate) THEN last_day(o_orderdate + INTERVAL 1 MONTH) ELSE CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) END, '%Y-%m-%d')"),
    ("MONTHS_BETWEEN", made("MONTHS_BETWEEN", lambda: F.trunc(c(D), "month"), lambda: F.lit("1990-01-01").cast("date")), "CAST(datediff('month', DATE '1990-01-01', date_trunc('month', o_orderdate)) AS DOUBLE)"),
    ("NEXT_DAY", made("NEXT_DAY", col(D), "Sunday", shown="yyyy-MM-dd"), "strftime(o_orderdate + to_days(CAST(7 - dayofweek(o_orderdate) AS INT)), '%Y-%m-%d')"),
    *((n, made(n, lambda: odd()), f"{w}({ODD})") for n, w in {"DAYOFMONTH": "day", "HOUR": "hour", "MINUTE": "minute", "SECOND": "second"}.items()),
    ("MICROSECOND", made("MICROSECOND", lambda: odd() + F.make_dt_interval(secs=F.lit(0.25))), "250000"),
    ("DAYOFWEEK", made("DAYOFWEEK", col(D)), "dayofweek(o_orderdate) + 1"),
    ("WEEKDAY", made("WEEKDAY", col(D)), "isodow(o_orderdate) - 1"),
    ("DATEDIFF", made("DATEDIFF", lambda: odd(), lambda: F.lit("1995-01-01").cast("date")), f"datediff('day', DATE '1995-01-01', CAST({ODD} AS DATE))"),
    ("__OVERLAPS", made("__OVERLAPS", col(D), lambda: F.add_months(c(D), 2).cast("timestamp"), lambda: F.lit("1995-01-01").cast("timestamp"), lambda: F.lit("1996-01-01").cast("timestamp")), "o_orderdate < TIMESTAMP '1996-01-01' AND TIMESTAMP '1995-01-01' < o_orderdate + INTERVAL 2 MONTH"),
)

doc = lambda: F.concat(F.lit('{"a": '), c(P), F.lit(', "l": [1, "x", null], "s": "t"}'))
DOC = """('{"a": ' || props || ', "l": [1, "x", null], "s": "t"}')"""
K = "CAST(json_extract(props, '$.k') AS VARCHAR)"

rows("events", "event_id",
    ("JSON", made("JSON", lambda: F.concat(c(P), F.lit(" "))), "CAST(json_object('k', json_extract(props, '$.k')) AS VARCHAR)"),
    ("JSONB", made("JSONB", lambda: F.concat(F.lit(" "), c(P))), "CAST(json_object('k', json_extract(props, '$.k')) AS VARCHAR)"),
    ("JSON_EXTRACT", made("JSON_EXTRACT", doc, "$.a.k"), K),
    ("JSON_EXTRACT_PATHS", made("JSON_EXTRACT", doc, "$.a.k", "$.l[1]", "$.zz"), f"'[' || {K} || ',\"x\",null]'"),
    ("JSONB_EXTRACT", made("JSONB_EXTRACT", doc, "$.l"), "'[1,\"x\",null]'"),
    ("JSON_ARRAY", made("JSON_ARRAY", 1, "a", none(), col("event_id"), True), "'[1,\"a\",' || event_id || ',true]'"),
    ("JSONB_ARRAY", made("JSONB_ARRAY", 1.5, col("event_type")), "'[1.5,\"' || event_type || '\"]'"),
    ("JSON_VALUE", made("JSON_VALUE", doc, "$.a.k", "NUMBER"), f"CAST({K} AS DOUBLE)"),
    ("JSON_VALUE_DEFAULT", lambda: F.concat(call("JSON_VALUE", doc(), "$.q", "VARCHAR2", "none"), F.coalesce(call("JSON_VALUE", doc(), "$.l"), F.lit("-"))), "'none-'"),
    ("JSON_QUERY", made("JSON_QUERY", doc, "$.l"), "'[1,\"x\",null]'"),
    ("JSON_QUERY_WRAPPER", made("JSON_QUERY", doc, "$.s", "WITH WRAPPER"), "'[\"t\"]'"),
    ("JSON_EXISTS", made("JSON_EXISTS", doc, "$.l[1]"), "true"),
    ("ARROW", made("->", doc, "s"), "'\"t\"'"),
    ("ARROW_INDEX", lambda: call("->", call("->", doc(), "l"), 0), "'1'"),
    ("LONG_ARROW", made("->>", doc, "s"), "'t'"),
    ("JSON_MERGEPATCH", made("JSON_MERGEPATCH", col(P), '{"k":null,"m":[1]}'), "'{\"m\":[1]}'"),
    ("JSON_ARRAY_LENGTH", made("JSON_ARRAY_LENGTH", lambda: F.get_json_object(doc(), "$.l")), "3"),
    ("JSONB_ARRAY_LENGTH", made("JSONB_ARRAY_LENGTH", col(P)), "0"),
    ("JSON_PRETTY", made("JSON_PRETTY", col(P)), f"'{{' || chr(10) || '  \"k\": ' || {K} || chr(10) || '}}'"),
    ("JSONB_OBJECT", made("JSONB_OBJECT", "id", col("event_id"), "n", none()), "'{\"id\":' || event_id || ',\"n\":null}'"),
    ("JSONB_SET", made("JSONB_SET", col(P), "$.k", 7), "'{\"k\":7}'"),
    ("JSONB_INSERT", made("JSONB_INSERT", col(P), "$.z", 7), f"'{{\"k\":' || {K} || ',\"z\":7}}'"),
    ("JSONB_REPLACE", made("JSONB_REPLACE", col(P), "$.z", 7), f"'{{\"k\":' || {K} || '}}'"),
    ("JSONB_REMOVE", made("JSONB_REMOVE", col(P), "$.k"), "'{}'"),
    ("JSONB_PATCH", made("JSONB_PATCH", col(P), '{"k":1}'), "'{\"k\":1}'"),
    ("JSONB_QUOTE", made("JSONB_QUOTE", col("event_type")), "'\"' || event_type || '\"'"),
    ("JSONB_TYPE", made("JSONB_TYPE", doc, "$.l"), "'array'"),
    ("JSONB_VALID", made("JSONB_VALID", lambda: F.concat(c(P), F.lit("x"))), "0"),
    ("JSON_ERROR_POSITION", made("JSON_ERROR_POSITION", col(P)), "0"),
    ("IS_JSON", lambda: call("JSON_VALID", c("event_type")) == 1, "false"),
)

E = "CAST(embedding AS DOUBLE[])"
R = "CAST(list_reverse(embedding) AS DOUBLE[])"
back = lambda: F.reverse(V)
rows("embeddings", "vec_id",
    ("VEC", lambda: F.size(call("VEC", F.to_json(c(V)))), "CAST(len(embedding) AS INT)"),
    ("VEC_F32", lambda: call("VEC_F32", "[1, 2.5]")[1], "CAST(2.5 AS FLOAT)"),
    ("VEC_TYPE", made("VEC_TYPE", col(V)), "'float32'"),
    ("VEC_TO_JSON", lambda: call("VEC_TO_JSON", F.transform(c(V), lambda x: F.floor(x).cast("double"))), "'[' || array_to_string([CAST(floor(x) AS BIGINT) || '.0' FOR x IN embedding], ',') || ']'"),
    *((n, made(n, col(V), back, digits=5), f"round(list_distance({E}, {R}), 5)") for n in ("VEC_L2", "VEC_DISTANCE_L2")),
    *((n, made(n, col(V), back, digits=5), f"round(list_dot_product({E}, {R}), 5)") for n in ("VEC_IP", "VEC_DOT")),
    *((n, made(n, col(V), back, digits=5), f"round(1 - list_cosine_similarity({E}, {R}), 5)") for n in ("VEC_COSINE", "VEC_DISTANCE_COSINE")),
    ("VEC_NORMALIZE", lambda: F.round(call("VEC_NORM", call("VEC_NORMALIZE", c(V))), 5), "1.0"),
    ("VEC_ADD", lambda: F.round(call("VEC_ADD", c(V), back())[0].cast("double"), 5), "round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[-1] AS DOUBLE), 5)"),
    ("VEC_SUB", lambda: F.round(call("VEC_SUB", c(V), back())[0].cast("double"), 5), "round(CAST(embedding[1] AS DOUBLE) - CAST(embedding[-1] AS DOUBLE), 5)"),
)
scalar("BM25", "documents", "doc_id", lambda: F.round(call("BM25", c("text"), "license"), 9), "(SELECT round(2.2 * n / (n + 1.2), 9) FROM (SELECT CAST(coalesce(len(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: x = 'license')), 0) AS DOUBLE) AS n))")
query("fn_counters", "SELECT 0 AS a, 0 AS b, 0 AS c")(lambda spark, d: spark.range(1).select(call("LAST_INSERT_ROWID").alias("a"), call("CHANGES").alias("b"), call("TOTAL_CHANGES").alias("c")))
query("fn_grouping", "SELECT c_mktsegment, grouping(c_mktsegment) AS g, grouping_id(c_mktsegment, c_nationkey) AS i, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")(
    lambda spark, d: t(spark, d, "customer").rollup("c_mktsegment", "c_nationkey").agg(call("GROUPING", c("c_mktsegment")).alias("g"), call("GROUPING_ID", c("c_mktsegment"), c("c_nationkey")).alias("i"), F.count("*").alias("n")).select("c_mktsegment", "g", "i", "n")
)
