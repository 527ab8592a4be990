"""Scalar functions on literal values, with results worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from basaltql.functions.json_text import json_object, json_tree
from basaltql.functions.scalar import FUNCTIONS, call
from basaltql.functions.texts import to_char_number

DOC = '{"a":1,"b":[10,20],"c":{"d":"x"}}'
T = "2024-01-31 10:20:30"


def vector():
    return F.array(F.lit(3.0), F.lit(4.0))


def null():
    return F.lit(None).cast("string")


CASES = {
    "set": (lambda: call("JSON_SET", DOC, "$.a", 2, "$.n", "t"), '{"a":2,"b":[10,20],"c":{"d":"x"},"n":"t"}'),
    "set_inner": (lambda: call("JSON_SET", DOC, "$.c.d", '{"k":true}'), '{"a":1,"b":[10,20],"c":{"d":{"k":true}}}'),
    "insert": (lambda: call("JSON_INSERT", DOC, "$.a", 2, "$.b[2]", 30), '{"a":1,"b":[10,20,30],"c":{"d":"x"}}'),
    "replace": (lambda: call("JSON_REPLACE", DOC, "$.a", F.lit(None).cast("int"), "$.z", 1), '{"a":null,"b":[10,20],"c":{"d":"x"}}'),
    "set_root": (lambda: call("JSON_SET", DOC, "$", 5), "5"),
    "set_bad": (lambda: call("JSON_SET", "{", "$.a", 5), None),
    "remove": (lambda: call("JSON_REMOVE", DOC, "$.b[0]", "$.c", "$.zz"), '{"a":1,"b":[20]}'),
    "patch": (lambda: call("JSON_PATCH", DOC, '{"a":null,"c":{"e":1}}'), '{"b":[10,20],"c":{"d":"x","e":1}}'),
    "type": (lambda: call("JSON_TYPE", DOC, "$.b"), "array"),
    "type_real": (lambda: call("JSON_TYPE", "1.5"), "real"),
    "type_missing": (lambda: call("JSON_TYPE", DOC, "$.q"), None),
    "pretty": (lambda: call("JSON_PRETTY", '{"a":[1]}'), '{\n  "a": [\n    1\n  ]\n}'),
    "position": (lambda: call("JSON_ERROR_POSITION", '{"a":x}'), 6),
    "position_valid": (lambda: call("JSON_ERROR_POSITION", DOC), 0),
    "quote": (lambda: call("JSON_QUOTE", 'a"b'), '"a\\"b"'),
    "quote_null": (lambda: call("JSON_QUOTE", null()), "null"),
    "object": (lambda: call("JSON_OBJECT", "a", 1, "b", null()), '{"a":1,"b":null}'),
    "object_absent": (lambda: json_object(F.lit("a"), F.lit(1), F.lit("b"), null(), absent_on_null=True), '{"a":1}'),
    "vec": (lambda: call("VEC", "[1, 2.5]"), [1.0, 2.5]),
    "vec_dim": (lambda: call("VEC_DIM", vector()), 2),
    "vec_length": (lambda: call("VEC_LENGTH", vector()), 8),
    "vec_slice": (lambda: call("VEC_SLICE", vector(), 1, 9), [4.0]),
    "vec_slice_none": (lambda: call("VEC_SLICE", vector(), 2, 1), []),
    "vec_norm": (lambda: call("VEC_NORM", vector()), 5.0),
    "vec_l2sq": (lambda: call("VEC_L2SQ", vector(), F.array(F.lit(0.0), F.lit(0.0))), 25.0),
    "vec_cosine_zero": (lambda: call("VEC_COSINE", vector(), F.array(F.lit(0.0), F.lit(0.0))), 1.0),
    "vec_add": (lambda: call("VEC_ADD", vector(), vector()), [6.0, 8.0]),
    "vec_normalize_zero": (lambda: call("VEC_NORMALIZE", F.array(F.lit(0.0))), [0.0]),
    "rrf": (lambda: F.round(call("RRF", F.lit(1), F.lit(None).cast("int"), F.lit(2)), 9), round(1 / 61 + 1 / 62, 9)),
    "date": (lambda: call("DATE", T), "2024-01-31"),
    "date_month_overflow": (lambda: call("DATE", T, "+1 month"), "2024-03-02"),
    "date_month_back": (lambda: call("DATE", "2024-01-15", "-1 month"), "2023-12-15"),
    "date_year": (lambda: call("DATE", "2024-02-29", "+1 year"), "2025-03-01"),
    "datetime_steps": (lambda: call("DATETIME", T, "start of month", "+1.5 hours"), "2024-01-01 01:30:00"),
    "weekday": (lambda: call("DATE", T, "weekday 0"), "2024-02-04"),
    "weekday_same": (lambda: call("DATE", T, "weekday 3"), "2024-01-31"),
    "unixepoch": (lambda: call("DATETIME", 86400, "unixepoch"), "1970-01-02 00:00:00"),
    "bad_modifier": (lambda: call("DATE", T, "next moon"), None),
    "time": (lambda: call("TIME", T, "+40 seconds"), "10:21:10"),
    "timediff": (lambda: call("TIMEDIFF", "2024-01-01 00:00:00", "2024-01-02 01:02:03.5"), "-0000-00-01 01:02:03.500"),
    "from_unixtime": (lambda: call("FROM_UNIXTIME", 0, "%Y/%m"), "1970/01"),
    "from_tz": (lambda: call("FROM_TZ", T, "+02:00"), T + "+02:00"),
    "at_time_zone": (lambda: call("__AT_TIME_ZONE", T + "+02:00", "-01:30"), "2024-01-31 06:50:30"),
    "timestamp_tz": (lambda: call("TO_TIMESTAMP_TZ", T + " +05:00").cast("string"), T),
    "tz_offset": (lambda: call("TZ_OFFSET", "Europe/Paris"), "+00:00"),
    "yminterval": (lambda: call("TO_YMINTERVAL", "1-2"), 425),
    "dsinterval": (lambda: call("TO_DSINTERVAL", "2 12:00:00"), 2.5),
    "dsinterval_time": (lambda: call("TO_DSINTERVAL", "06:00:00"), 0.25),
    "numtods": (lambda: call("NUMTODSINTERVAL", 36, "HOUR"), 1.5),
    "numtoym": (lambda: F.lit(datetime.date(2024, 1, 31)) + call("NUMTOYMINTERVAL", 1, "MONTH"), datetime.date(2024, 2, 29)),
    "extract": (lambda: call("EXTRACT", "MINUTE", F.lit(T).cast("timestamp")), 20),
    "number_group": (lambda: to_char_number(F.lit(-1234567.891), "9,999,999.00"), "-1,234,567.89"),
    "number_zero": (lambda: to_char_number(F.lit(42), "FM00000"), "00042"),
    "number_blank": (lambda: to_char_number(F.lit(42), "999"), " 42"),
    "number_mi": (lambda: to_char_number(F.lit(-5), "99MI"), "5-"),
    "number_s": (lambda: to_char_number(F.lit(5), "S99"), "+5"),
    "number_s_after": (lambda: to_char_number(F.lit(1234.5), "9G999D99S"), "1,234.50+"),
    "asciistr": (lambda: call("ASCIISTR", "aé€😀"), "a\\00E9\\20AC\\D83D\\DE00"),
    "unistr": (lambda: call("UNISTR", "a\\00E9\\D83D\\DE00"), "aé😀"),
    "dump": (lambda: call("DUMP", "aé"), "Len=3: 97,195,169"),
    "ora_hash_small": (lambda: call("ORA_HASH", "x", 0), 0),
    "randomblob": (lambda: F.length(call("RANDOMBLOB", 12)), 12),
    "xmlforest": (lambda: call("XMLFOREST", "a", 1, "b", null(), "c", "y"), "<a>1</a><c>y</c>"),
    "xmlquery": (lambda: call("XMLQUERY", "1 + 2 * 3"), 7),
    "fts5_tf": (lambda: call("FTS5_TF", "red fox, Red foxes", "red OR fox*"), 4),
    "bm25": (lambda: F.round(call("BM25", "red red", "red"), 6), 1.375),
    "context": (lambda: call("SYS_CONTEXT", "USERENV", "nothing"), "UNKNOWN"),
    "raise_ignore": (lambda: call("RAISE", "IGNORE"), None),
    "binary_double": (lambda: call("TO_BINARY_DOUBLE", "x1"), None),
}


@pytest.fixture(scope="module")
def results(spark):
    return spark.range(1).select(*(make().alias(name) for name, (make, _) in CASES.items())).first().asDict()


@pytest.mark.parametrize("name", CASES)
def test_value(results, name):
    assert results[name] == CASES[name][1]


def test_hash_is_fnv(spark):
    h = 0x811C9DC5
    for b in "é7|3".encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    assert spark.range(1).select(call("ORA_HASH", "é7", 99, 3).alias("v")).first().v == h % 100


def test_tree_lists_parents_first(spark):
    got = json_tree(spark.createDataFrame([(1, DOC)], "id int, doc string"), "doc").collect()
    assert [(r.fullkey, r.type) for r in got] == [("$", "object"), ("$.a", "integer"), ("$.b", "array"), ("$.b[0]", "integer"), ("$.b[1]", "integer"), ("$.c", "object"), ("$.c.d", "text")]


def test_errors(spark):
    with pytest.raises(ValueError):
        call("JSON_SET", DOC, "$.a")
    with pytest.raises(Exception, match="dimensions"):
        spark.range(1).select(call("VEC_ADD", vector(), F.array(F.lit(1.0)))).collect()


def test_the_whole_registry_is_there():
    assert len(FUNCTIONS) >= 272
