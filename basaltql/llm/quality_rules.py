"""Quality rules: a table of thresholds, compiled into one projection of length, symbol, stop-word and line ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_tools import keyed, read

SYMBOLS = "#*$%&|<>"
#: Very common words of the languages in question.
STOP_WORDS = "the be to of and that have with in is for it as de la le et les des un une en que el los las y der die und das von zu den ist il di e che".split()
#: name, measure, in proportion to (1: as it is), least, most
RULES = [
    ("word_length", "word_chars", "n_words", 1.5, 15.0),
    ("symbols", "n_symbols", "n_words", None, 0.1),
    ("shouting", "n_exclaims", "n_words", None, 0.2),
    ("capitals", "n_capitals", "word_chars", None, 0.4),
    ("stop_words", "n_stop_words", "n_words", 0.01, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    ("repeated_words", "n_repeat_words", "n_words", None, 0.5),
]


def without(text: Column, characters: str) -> Column:
    """How many of these characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(words: str) -> Column:
    """Words inside 3-word windows that are found twice or more. Windows are compared whole; their hashes only tell the many
    texts that repeat none."""
    places = f"sequence(0, size({words}) - 3)"
    hashes = f"transform({places}, i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))"
    ordered = f"array_sort(transform({places}, i -> named_struct('k', concat_ws(' ', {words}[i], {words}[i + 1], {words}[i + 2]), 'i', i)))"
    often = f"transform(array({ordered}), s -> array_sort(transform(filter(transform(s, (x, j) -> named_struct('i', x.i, 'often', coalesce(x.k = get(s, j - 1).k, false) or coalesce(x.k = get(s, j + 1).k, false))), y -> y.often), y -> y.i)))[0]"
    covered = f"transform(array({often}), p -> aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1) - x, 3))), 0L, (a, n) -> a + n))[0]"
    return F.expr(f"CASE WHEN size({words}) < 3 THEN 0L WHEN size(array_distinct({hashes})) = size({words}) - 2 THEN 0L ELSE {covered} END")


def compiled(rules: list[tuple]) -> Column:
    """The rule table as one boolean: every measure within its limits. No limit holds for a text without words."""
    checks = []
    for _, measure, of, least, most in rules:
        base = F.lit(1.0) if of == 1 else F.col(of).cast("double")
        checks += [F.col(measure) >= F.lit(least) * base] if least is not None else []
        checks += [F.col(measure) <= F.lit(most) * base] if most is not None else []
    return reduce(lambda a, b: a & b, checks)


def measure(docs: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """(doc_id, text_hash, measures, base_failed, kept), one row for each row of docs (doc_id, text and any others).

    Words are `[^\\x20\\x09-\\x0D]+`. base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows.
    kept: false if base_failed, else whether every rule holds. A null text counts as empty: no words, base_failed. An empty
    table gives no rows."""
    text = F.coalesce("text", F.lit(""))
    split = keyed(docs).select("doc_id", "text_hash", text.alias("text"), F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "").alias("words"), F.filter(F.split(text, "\\n"), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]"))).alias("lines"))
    measures = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.translate("text", " \t\n\x0b\x0c\r", "")),
        "n_symbols": without(F.col("text"), SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words("words"),
        "n_lines": F.size("lines"),
        "n_exclaims": without(F.col("text"), "!"),
        "n_capitals": without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_stop_words": F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))),
    }
    measured = split.select("doc_id", "text_hash", *(m.cast("long").alias(n) for n, m in measures.items()))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.select("*", failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
