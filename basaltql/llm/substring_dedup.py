"""Repeated passages: a sparse de Bruijn graph of 20-word k-mers, compacted into paths and verified at source coordinates.

Edges are the windows of WINDOW words. Each is filed under its smallest ANCHOR_WORDS-gram (its minimizer), so that equal
windows meet in one partition, and runs of neighbouring windows with the same minimizer travel as one record, with one
coordinate and the eight bytes of a hash a window. A part of the input sends each window once, however often it holds it. In a partition
the first coordinate of each repeated edge is found, and neighbouring repeated edges of a document whose first coordinates
are neighbours as well become one edge, a piece. What remains is compacted by Spark: a node lies between two windows, at a
place in the document and the place in its source that has the same words; it branches unless as many pieces enter it as
leave it. Nodes that don't branch vanish, and a join of the others, by their order on a diagonal of document and source, gives
the maximal paths. A path names its source coordinates; fingerprints of both strands, taken from the texts, confirm it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spark_tools import MOST_PARTITIONS, bounded_batches, forget, gathered, hot_keys, keyed, looked_up, parts_for, read, slices, written
from .text_arrays import U, grams, mix, ranges, span_hash, words_of

WINDOW, ANCHOR_WORDS = 20, 6
#: Text bytes of a part of the input within which windows are sent once.
PART_BYTES = 4 << 20
#: Text bytes of the input whose edges a bucket holds.
BUCKET_BYTES = 8 << 20
#: Text bytes of an Arrow batch whose words are Python objects.
TEXT_BYTES = 8 << 20
#: Sorts after every doc_id; rows without one come last.
NO_ID = np.iinfo(np.int64).max
PIECE = np.dtype([("start", "<i4"), ("length", "<i4"), ("source", "<i8"), ("source_hash", "<i8"), ("source_start", "<i4")])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, minimizer, row, start) of every window, by row and start."""
    words = words_of(texts)
    sums = words.sums()
    hashes, places, counts = grams(words, WINDOW, sums)
    if not len(hashes):
        return hashes, hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(words.hashes) - ANCHOR_WORDS + 1
    every = np.arange(n)
    anchors = sliding_min(span_hash(sums, every, every + ANCHOR_WORDS), WINDOW - ANCHOR_WORDS + 1)[places]
    rows = np.repeat(np.arange(len(counts)), counts)
    return hashes, anchors, rows, places - words.bounds[rows]


def joined_pieces(doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray, source: np.ndarray, source_hash: np.ndarray, source_start: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Neighbouring windows of a document whose sources are neighbours, too, as one piece; the pieces of each document."""
    if not len(doc):
        return []
    order = np.lexsort((start, text_hash, doc))
    doc, text_hash, start, source, source_hash, source_start = (x[order] for x in (doc, text_hash, start, source, source_hash, source_start))
    same = lambda x: x[1:] == x[:-1]
    fresh = np.ones(len(doc), bool)
    again = same(doc) & same(text_hash) & same(start)
    fresh[1:] = ~again
    doc, text_hash, start, source, source_hash, source_start = (x[fresh] for x in (doc, text_hash, start, source, source_hash, source_start))
    head = np.ones(len(doc), bool)
    head[1:] = ~(same(doc) & same(text_hash) & (np.diff(start) == 1) & same(source) & same(source_hash) & (np.diff(source_start) == 1))
    first = np.flatnonzero(head)
    pieces = np.zeros(len(first), PIECE)
    pieces["start"], pieces["source"], pieces["source_hash"], pieces["source_start"] = start[first], source[first], source_hash[first], source_start[first]
    pieces["length"] = np.diff(np.append(first, len(doc)))
    d, h = doc[first], text_hash[first]
    cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])))
    return [(int(d[i]), int(h[i]), pieces[i:j].tobytes()) for i, j in zip(cut, np.append(cut[1:], len(d)), strict=True)]


def first_of_each(keys: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, first): indices of windows that a smaller coordinate with the same key precedes, and of that one."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    equal = k[1:] == k[:-1]
    often = np.zeros(len(k), bool)
    often[1:] |= equal
    often[:-1] |= equal
    order = order[often]
    order = order[np.lexsort((start[order], doc[order], keys[order]))]
    k = keys[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))] if len(k) else order
    later = (doc[order] != doc[first]) | (start[order] != start[first])
    return order[later], first[later]


def _edges(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", PART_BYTES):
            ids = batch.column("doc_id").to_numpy()
            texts_hash = batch.column("text_hash").to_numpy()
            hashes, anchors, rows, starts = windows(batch.column("text"))
            if not len(hashes):
                continue
            doc, th = ids[rows], texts_hash[rows]
            later, first = first_of_each(hashes, doc, starts)
            out = []
            pieces = joined_pieces(doc[later], th[later], starts[later], doc[first], th[first], starts[first])
            send = np.ones(len(hashes), bool)
            send[later] = False
            anchors, rows, starts, sent = anchors[send], rows[send], starts[send], hashes[send]
            head = np.ones(len(rows), bool)
            head[1:] = (rows[1:] != rows[:-1]) | (anchors[1:] != anchors[:-1]) | (np.diff(starts) != 1)
            #: A run's length is one byte; longer ones are cut.
            place = np.arange(len(rows))
            head |= (place - np.maximum.accumulate(np.where(head, place, 0))) % 255 == 0
            runs = np.flatnonzero(head)
            counts = np.diff(np.append(runs, len(rows)))
            bucket = (mix(anchors[runs]) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                r = order[cuts[b] : cuts[b + 1]]
                record = [anchors[runs[r]], ids[rows[runs[r]]], texts_hash[rows[runs[r]]], starts[runs[r]].astype(np.int32), counts[r].astype(np.uint8), sent[ranges(runs[r], counts[r])]]
                out.append((b, None, None, np.array([len(r)], np.int64).tobytes() + b"".join(x.tobytes() for x in record)))
            out += [(int(b), d, t, p) for (d, t, p), b in zip(pieces, np.arange(len(pieces)) * 7919 % buckets, strict=True)]
            yield pa.RecordBatch.from_pylist([{"bucket": b, "doc_id": d, "text_hash": t, "payload": p} for b, d, t, p in out], schema=pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("payload", pa.binary())]))

    return run


PATHS = "doc_id long, text_hash long, start int, length int, source long, source_hash long, source_start int"
_FIELDS = ["doc_id", "text_hash", *PIECE.names]


def _unpacked(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Pieces of documents as rows of PATHS."""
    pieces = np.frombuffer(b"".join(p for _, _, p in found), PIECE)
    counts = [len(p) // PIECE.itemsize for _, _, p in found]
    columns = [np.repeat(np.array([x[i] for x in found], np.int64), counts) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (*columns, *(pieces[n] for n in PIECE.names))], _FIELDS)


def _matched(held: list[list[np.ndarray]]) -> list[tuple[int, int, bytes]]:
    """What the runs of a bucket repeat."""
    anchors, doc, th, starts, counts, sent = (np.concatenate([h[i] for h in held]) for i in range(6))
    #: Only anchors of two runs or more can hold a repeated window.
    order = np.argsort(anchors, kind="stable")
    equal = anchors[order][1:] == anchors[order][:-1]
    often = np.zeros(len(anchors), bool)
    often[order[1:][equal]] = True
    often[order[:-1][equal]] = True
    ends = np.cumsum(counts)
    r = np.flatnonzero(often)
    n = counts[r]
    at = ranges((ends - counts)[r], n)
    keys = sent[at]
    doc, th, starts = np.repeat(doc[r], n), np.repeat(th[r], n), ranges(starts[r].astype(np.int64), n)
    later, first = first_of_each(keys, doc, starts)
    return joined_pieces(doc[later], th[later], starts[later], doc[first], th[first], starts[first])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a partition's buckets, which come one after the other; pieces found before pass through."""
    held: list[list[np.ndarray]] = []
    bucket = None
    for batch in batches:
        found: list[tuple[int, int, bytes]] = []
        for at, doc, th, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text_hash", "payload")), strict=True):
            if at != bucket and held:
                found += _matched(held)
                held.clear()
            bucket = at
            if th is not None:
                found.append((doc, th, payload))
                continue
            n, place, parts = int(np.frombuffer(payload, np.int64, 1)[0]), 8, []
            for kind in (U, np.int64, np.int64, np.int32, np.uint8):
                parts.append(np.frombuffer(payload, kind, n, place))
                place += n * np.dtype(kind).itemsize
            held.append([*parts[:-1], parts[-1].astype(np.int64), np.frombuffer(payload[place:], U)])
        if found:
            yield _unpacked(found)
    if held and (found := _matched(held)):
        yield _unpacked(found)


def compacted(pieces: DataFrame) -> DataFrame:
    """The maximal paths (PATHS) of pieces (PATHS); pieces may overlap and repeat."""
    strand = ["doc_id", "text_hash", "source", "source_hash"]
    end = lambda moved, leaves: F.struct((F.col("start") + moved).alias("at"), (F.col("source_start") + moved).alias("there"), F.lit(leaves).alias("leaves"))
    ends = pieces.select(*strand, F.inline(F.array(end(F.lit(0), 1), end(F.col("length"), -1))))
    nodes = ends.groupBy(*strand, "at", "there").agg(F.sum("leaves").cast("int").alias("open")).where("open <> 0")
    #: A path keeps to its diagonal; the first to begin there is the first to end.
    line = [*strand, "diagonal"]
    tips = nodes.withColumn("diagonal", F.col("at") - F.col("there")).withColumn("begins", F.col("open") > 0).withColumn("n", F.explode(F.sequence(F.lit(1), F.abs("open"))))
    ranked = tips.withColumn("n", F.row_number().over(Window.partitionBy(*line, "begins").orderBy("at", "n")))
    heads, tails = ranked.where("begins"), ranked.where("not begins").select(*line, "n", F.col("at").alias("close"))
    return heads.join(tails, [*line, "n"]).select("doc_id", "text_hash", F.col("at").alias("start"), (F.col("close") - F.col("at")).alias("length"), "source", "source_hash", F.col("there").alias("source_start"))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-1 of the words under each path (starts, lengths) of a text."""
    for batch in slices(batches, "text", TEXT_BYTES):
        out: list[tuple] = []
        for doc, th, text, starts, lengths in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "starts", "lengths")), strict=True):
            words = (text or "").encode().split()
            for s, n in zip(starts, lengths, strict=True):
                out.append((doc, th, s, n, hashlib.sha1(b" ".join(words[s : s + n + WINDOW - 1])).digest()[:12]))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["doc_id", "text_hash", "start", "length", "print"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", TEXT_BYTES):
        out: list[tuple] = []
        for text, starts, lengths in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "lengths")), strict=True):
            words = (text or "").encode().split()
            n = len(words)
            if starts:
                change = np.zeros(n + 1, np.int32)
                np.add.at(change, np.array(starts), 1)
                np.add.at(change, np.array(starts) + np.array(lengths) + WINDOW - 1, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(change[:n]) == 0).tolist()]
            out.append((n, n - len(words), b" ".join(words).decode()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_text"])


def by_key(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) with NO_ID for a missing doc_id: the same exchange serves every join on it."""
    return keyed(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(int(NO_ID))))


def repeated_paths(texts: DataFrame) -> DataFrame:
    """Verified paths of the texts (by_key): PATHS. length counts windows; the words are length + WINDOW - 1."""
    buckets = parts_for(texts, BUCKET_BYTES)
    edges = texts.mapInArrow(_edges(buckets), "bucket int, doc_id long, text_hash long, payload binary")
    dealt = edges.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")
    pieces = written(dealt.mapInArrow(_repeats, PATHS), "pieces")
    paths = written(compacted(pieces), "paths")
    forget(pieces)
    own, there = ["doc_id", "text_hash", "start", "length"], ["source", "source_hash", "source_start", "length"]
    spans = paths.select(own).union(paths.select(there)).distinct()
    of_text = spans.groupBy("doc_id", "text_hash").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))
    prints = texts.join(of_text, ["doc_id", "text_hash"]).mapInArrow(_fingerprints, "doc_id long, text_hash long, start int, length int, print binary").distinct()
    prints = written(prints, "prints")
    #: Many paths can have one source.
    sourced = looked_up(paths, prints.toDF(*there, "source_print"), there, hot_keys(paths, there))
    return sourced.join(prints, own).where("print = source_print").select(*own, "source", "source_start")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row for each row of docs (doc_id, text and any others).

    Each word is removed that a window of 20 words covers whose words also start at a smaller coordinate (doc_id, start),
    judged on the input. kept_text: the other words, joined by a space. Null, empty or short texts lose nothing. Rows
    without doc_id come last in this order; rows with one doc_id share their coordinates, so equal rows don't remove each
    other. An empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    texts = by_key(docs)
    spans = repeated_paths(texts).groupBy("doc_id", "text_hash").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))
    out = texts.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts", "lengths").mapInArrow(_without, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(int(NO_ID))))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
