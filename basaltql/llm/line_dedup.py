"""Repeated lines, exact or within one word edit, by a deletion neighbourhood; the earliest line stays.

Two lines are within one edit (a word replaced, inserted or deleted) if they agree after deleting one word at the same
place in both, or if one is the other with a word deleted. So each line emits a hashed key for every such deletion, equal
keys are joined, and the true edit distance is verified on the words. A line of 50 words has 100 keys, so only lines emit
them that can have a partner at all: of two lines within one edit, either the first or the last half is equal. A group of
equal keys is reduced to its earliest line before the shuffle, so no pairs arise within it, however large it is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spark_tools import bounded_batches, gathered, read, slices, written
from .substring_dedup import NO_ID, by_key, first_of_each
from .text_arrays import SPAN_SALT, U, Words, folded, minus, mix, powers, ranges, reduced, span_hash, times, words_of

#: By default shorter lines stay (the queries pass EVERY_LINE); lines of at least NEAR_WORDS words go also for a near copy.
LEAST_WORDS, EVERY_LINE, NEAR_WORDS = 3, 1, 8
PART_BYTES, TEXT_BYTES = 4 << 20, 8 << 20
#: Of the second, independent hash of a line: lines are equal where all 128 bits are.
PRINT_SALT = 0x2545F4914F6CDD1D


def lines_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line, first word, end word) of each `\\n`-split line that has a word; line counts from 0 in its text."""
    breaks = np.flatnonzero(words.data == 10)
    rows = np.repeat(np.arange(len(words.texts) - 1), words.counts())
    number = np.searchsorted(breaks, words.starts) - np.searchsorted(breaks, words.texts[:-1])[rows]
    head = np.ones(len(rows), bool)
    head[1:] = (rows[1:] != rows[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(head)
    return rows[first], number[first], first, np.append(first[1:], len(rows)) if len(first) else first


def _lines(least_words: int):
    """Each line's two hashes and half keys, the lowest bit of which names the half (1: the last); a line that this part of the input has before gets a null hash: it will go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", PART_BYTES):
            words = words_of(batch.column("text"))
            rows, number, a, b = lines_of(words)
            long = b - a >= least_words
            rows, number, a, b = rows[long], number[long], a[long], b[long]
            sums = words.sums()
            hashes = span_hash(sums, a, b)
            prints = folded(words.hashed(PRINT_SALT)[ranges(a, b - a)], b - a, PRINT_SALT)
            doc = batch.column("doc_id").to_numpy()[rows]
            later, first = first_of_each(hashes, doc, number)
            later = later[prints[later] == prints[first]]
            again = np.zeros(len(rows), bool)
            again[later] = True
            n = b - a
            lists, who = [], []
            for h in (n // 2, (n - 1) // 2):
                use = np.flatnonzero((n >= NEAR_WORDS) & ~again & ((h == n // 2) if not lists else (h != n // 2)))
                for side, (x, y) in enumerate(((a, a + h), (b - h, b))):
                    lists.append(mix(span_hash(sums, x[use], y[use]) + h[use].astype(U)) & ~U(1) | U(side))
                    who.append(use)
            order = np.argsort(np.concatenate(who), kind="stable")
            counts = np.bincount(np.concatenate(who), minlength=len(rows))
            halves = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.concatenate(lists)[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(batch.column("text_hash").to_numpy()[rows]), pa.array(number.astype(np.int32)), pa.array(hashes.view(np.int64), mask=again), pa.array(prints.view(np.int64), mask=again), halves], ["doc_id", "text_hash", "line", "hash", "print", "halves"])

    return run


def deletions(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, place, raw) for each word of each span a..b: the polynomial of the span without that word."""
    n = b - a
    index = np.repeat(np.arange(len(a)), n)
    at = ranges(a, n)
    inverse = powers(len(sums) + 1, inverse=True)
    before, after = minus(sums[at], sums[a[index]]), minus(sums[b[index]], sums[at + 1])
    return index, at - a[index], reduced(times(before, inverse[a[index]]) + times(after, inverse[a[index] + 1]))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the asked lines. role 0: without the word at a place, the place counts; 1: without any word; 2: whole."""
    for batch in gathered(batches, "text", PART_BYTES):
        words = words_of(batch.column("text"))
        rows, number, a, b = lines_of(words)
        lists = batch.column("lines")
        asked = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()[: len(lists) + 1])).astype(np.int64) << 34 | lists.flatten().to_numpy()
        asked, sides = np.sort(asked >> 2), (asked & 3)[np.argsort(asked >> 2)]
        own = rows.astype(np.int64) << 32 | number
        pick = np.isin(own, asked)
        rows, number, a, b, sides = rows[pick], number[pick], a[pick], b[pick], sides[np.searchsorted(asked, own[pick])]
        sums = words.sums()
        index, place, rest = deletions(sums, a, b)
        #: Where only one half is shared, the edit lies in the other one.
        n = (b - a)[index]
        other = ((sides[index] & 1 > 0) & (place >= (n - 1) // 2)) | ((sides[index] & 2 > 0) & (place <= n // 2))
        index, place, rest = index[other], place[other], rest[other]
        keys = np.concatenate([mix(rest + (place.astype(U) + U(1)) * U(0x9FB21C651E98DF25)), mix(rest + SPAN_SALT), span_hash(sums, a, b)])
        index = np.concatenate([index, index, np.arange(len(a))])
        role = np.repeat(np.array([0, 1, 2], np.int8), [len(rest), len(rest), len(a)])
        doc, th = (batch.column(c).to_numpy()[rows][index] for c in ("doc_id", "text_hash"))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(role), pa.array(doc), pa.array(th), pa.array(number.astype(np.int32)[index])], ["key", "role", "doc_id", "text_hash", "line"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", TEXT_BYTES):
        out: list[tuple] = []
        for doc, th, text, lines in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "lines")), strict=True):
            parts = text.encode().split(b"\n")
            out += [(doc, th, i, parts[i].split()) for i in lines]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary())))], ["doc_id", "text_hash", "line", "words"])


def within_one_edit(x: list, y: list) -> bool:
    """Whether one replaced, inserted or deleted item at most makes x of y."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), len(x))
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [within_one_edit(x, y) for x, y in zip(batch.column("words").to_pylist(), batch.column("earlier_words").to_pylist(), strict=True)]
        yield batch.select(["doc_id", "text_hash", "line"]).filter(pa.array(keep, pa.bool_()))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", TEXT_BYTES):
        out = []
        for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            parts = (text or "").split("\n")
            gone = set(lines or ())
            n = sum(1 for p in parts if p.strip(" \t\n\r\x0b\x0c"))
            out.append((n, len(gone), text if not gone else "\n".join(p for i, p in enumerate(parts) if i not in gone)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "text_hash", "n_lines", "n_removed", "kept_text"])


def near_lines(texts: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line) of first occurrences that have an earlier line within one edit."""
    halves = lines.where("hash is not null and size(halves) > 0").select("hash", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("lo <> hi").select("half")
    candidates = halves.join(shared, "half", "left_semi").groupBy("hash").agg(F.bit_or(F.when(F.col("half").bitwiseAND(F.lit(1)) == 0, 1).otherwise(2)).alias("sides"))
    asked = firsts.join(candidates, "hash").groupBy("doc_id", "text_hash").agg(F.collect_list(F.col("line").cast("long") * 4 + F.col("sides")).alias("lines"))
    variants = texts.join(asked, ["doc_id", "text_hash"])
    variants = variants.mapInArrow(_variants, "key long, role byte, doc_id long, text_hash long, line int").withColumn("at", F.struct("doc_id", "line", "text_hash"))
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("at")))
    groups = variants.groupBy("key").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), least(0).alias("same"), least(1).alias("longer"), least(2).alias("whole")).where("lo <> hi")
    earlier = F.when(F.col("role") == 0, F.col("same")).when(F.col("role") == 1, F.col("whole")).otherwise(F.col("longer"))
    pairs = variants.join(groups, "key").withColumn("earlier", earlier).where("earlier.doc_id < at.doc_id or (earlier.doc_id = at.doc_id and earlier.line < at.line)")
    pairs = written(pairs.select("at", "earlier").distinct(), "line-pairs")
    ends = pairs.select("at").union(pairs.select("earlier")).distinct().select("at.*")
    contents = texts.join(ends.groupBy("doc_id", "text_hash").agg(F.collect_list("line").alias("lines")), ["doc_id", "text_hash"]).mapInArrow(_contents, "doc_id long, text_hash long, line int, words array<binary>").distinct()
    contents = contents.select(F.struct("doc_id", "line", "text_hash").alias("at"), "words")
    held = pairs.join(contents, "at").join(contents.select(F.col("at").alias("earlier"), F.col("words").alias("earlier_words")), "earlier")
    return held.select("at.*", "words", "earlier_words").mapInArrow(_verified, "doc_id long, text_hash long, line int").distinct()


def repeated_lines(texts: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_hash, lines): what goes of each of the texts (by_key) that loses a line."""
    lines = written(texts.mapInArrow(_lines(least_words), "doc_id long, text_hash long, line int, hash long, print long, halves array<long>"), "lines")
    same = ["hash", "print"]
    seen = lines.where("hash is not null").select(*same, F.struct("doc_id", "line", "text_hash").alias("at"))
    firsts = seen.groupBy(*same).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    copies = seen.join(firsts.where("n > 1"), same).where("first.doc_id <> at.doc_id or first.line <> at.line").select("at.*")
    near = near_lines(texts, lines, firsts.select("hash", "first.*"))
    columns = ["doc_id", "text_hash", "line"]
    gone = lines.where("hash is null").select(columns).union(copies.select(columns)).union(near.select(columns))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("lines"))


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column has the lines that go; it goes, too."""
    for batch in slices(batches, "text", TEXT_BYTES):
        out, last = [], batch.num_columns - 1
        for text, lines in zip(batch.column("text").to_pylist(), batch.column(last).to_pylist(), strict=True):
            gone = set(lines or ())
            out.append("\n".join(p for i, p in enumerate(text.split("\n")) if i not in gone) if gone else text)
        i = batch.schema.get_field_index("text")
        columns = batch.columns[:last]
        columns[i] = pa.array(out, batch.schema.field(i).type)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:last])


def drop_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the lines gone that line_dedup removes; all rows and columns stay."""
    bounded_batches(docs.sparkSession)
    mark = "_" * (1 + max(map(len, docs.columns)))
    doc, text_hash, lines = mark + "doc", mark + "hash", mark + "lines"
    gone = repeated_lines(by_key(docs), least_words).toDF(doc, text_hash, lines)
    ours = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))).withColumn(text_hash, F.xxhash64("text"))
    return ours.join(gone, [doc, text_hash], "left").select(*docs.columns, lines).mapInArrow(_rewritten, docs.schema)


def line_dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_removed, kept_text), one row for each row of docs (doc_id, text and any others).

    Lines are split at `\\n` and compared as sequences of words `[^\\x20\\x09-\\x0D]+`. A line of least_words words or more
    goes if an equal line has a smaller coordinate (doc_id, line). Of different lines of NEAR_WORDS words or more, the first
    occurrence goes as well if a first occurrence within one word edit is earlier. All is judged on the input. n_lines:
    lines with a word. A null text counts as empty, and its kept_text is null. Rows without doc_id come last in this order;
    rows with one doc_id share their coordinates, so equal rows don't remove each other. An empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    texts = by_key(docs)
    gone = repeated_lines(texts, least_words)
    out = texts.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", "text", "lines").mapInArrow(_without, "doc_id long, text_hash long, n_lines long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(int(NO_ID))))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents"), EVERY_LINE).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
