"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Everything is Spark SQL expressions. A text's spans of a kind come from its matches and the gaps between them, so offsets
count code points. Repeated groups in the patterns are possessive or bounded: Java's matcher then needs no recursion, however
long a text is. A cheap test comes first, so most texts are scanned once for each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_tools import keyed, read

_NAME, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Leftmost matches are those of the plain patterns: a match starts where a run starts, or where the last match ended.
EMAIL = rf"(?:(?<!{_NAME})|\G){_NAME}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Whole runs of digits with single separators, of 16 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
BASE_KINDS = ("email", "ip", "card", "phone")
#: Code points before a span in which context words count, what they add, and the least score of a span beyond the base.
CONTEXT, BONUS, KEEP = 40, 0.4, 0.5


def _length(c: Column) -> Column:
    return F.length(c).cast("long")


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches, code points, end exclusive."""
    kind = "array<struct<start: bigint, end: bigint, found: string>>"
    pairs = F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, found: F.struct(_length(gap).alias("gap"), found.alias("found")))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + _length(x["found"])
        more = F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found")))).alias("out"))
        return F.when(x["found"].isNull(), acc).otherwise(more)

    return F.when(guard, F.aggregate(pairs, empty, step, lambda acc: acc["out"])).otherwise(F.array().cast(kind))


def mod_97(found: Column) -> Column:
    """The ISO 7064 remainder of an IBAN: letters as two digits, the first four characters last."""
    plain = F.regexp_replace(found, r"\x20", "")
    letters = F.filter(F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), ""), lambda c: c != "")
    digit = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(letters, F.lit(0).cast("long"), lambda acc, c: digit(acc, c).cast("long"))


#: kind, pattern, cheap test, what confirms a match, score without context, context words
def rules(text: Column) -> list[tuple]:
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    return [
        ("email", EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True), 0.9, "mail|contact|write"),
        ("ip", IP, F.rlike(text, F.lit(IP)), lambda m: F.rlike(m, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$")), 0.5, r"\bip\b|address|host|server"),
        ("card", CARD, F.rlike(text, F.lit(CARD)), lambda m: F.call_function("luhn_check", digits(m)), 0.6, "card|credit|visa|payment"),
        ("phone", PHONE, F.contains(text, F.lit("+")), lambda m: F.length(digits(m)).between(8, 15), 0.5, r"phone|\btel\b|call|mobile"),
        ("iban", IBAN, F.rlike(text, F.lit(IBAN)), lambda m: mod_97(m) == 1, 0.7, "iban|account|bank|konto"),
        ("ssn", SSN, F.rlike(text, F.lit(SSN)), lambda m: F.lit(True), 0.3, "ssn|social security"),
    ]


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans), one row for each row of docs (doc_id, text and any others).

    spans: array of (kind, start, end, score) by kind as in rules, then start. Email, ip, card and phone spans that their
    check confirms always stay; others need a score of KEEP, which context words before them can lift. A null or empty text
    has no spans. An empty table gives no rows."""
    texts = keyed(docs)
    text = F.col("text")

    def spans_of(kind: str, pattern: str, guard: Column, confirm, score: float, words: str) -> Column:
        def scored(m: Column) -> Column:
            before = F.substring(text, F.greatest(m["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(m["start"], F.lit(CONTEXT)).cast("int"))
            lifted = F.when(F.rlike(F.lower(before), F.lit(words)), F.lit(min(1.0, score + BONUS))).otherwise(F.lit(score))
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), lifted.alias("score"))

        spans = F.transform(F.filter(matches(text, pattern, guard), lambda m: confirm(m["found"])), scored)
        return spans if kind in BASE_KINDS else F.filter(spans, lambda s: s["score"] >= KEEP)

    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint, score: double>>")
    return texts.select("doc_id", "text_hash", F.when(text.isNull(), none).otherwise(F.concat(*(spans_of(*r) for r in rules(text)))).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))
