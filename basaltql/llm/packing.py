"""Packing documents into sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents are dealt out evenly at random; a task tokenizes its share and packs each group of GROUP_DOCS documents on its
own, so no group meets another and no key can be hot. A document's whole runs of LENGTH ids are sequences by themselves;
its rest is an item. Items go, longest first, into the first bin that has room, found by descending a tree of the bins'
largest free room. Then the emptiest bins are dissolved: their ids are cut to fill the gaps of the others exactly."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Merges, byte_letters, merge_list
from .span_memory import SpanMemory
from .spark_tools import MOST_PARTITIONS, bounded_batches, input_bytes, keyed, read, slices
from .text_arrays import ranges, words_of

LENGTH, GROUP_DOCS, GROUP_TOKENS, END_ID = 2048, 4096, 4_000_000, 1
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: How the tokenizer splits words (its file's pattern), and the mark of a word's end.
PARTS = regex.compile(r"""\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+""")
#: Below it, normal forms change no letter. White space beyond the six characters, and added tokens, are the library's.
LATIN_END, ODD = "\u0180", regex.compile(r"\s|<\|")
#: Bytes of the input that a task packs, a group after the other.
PART_BYTES = 16 << 20
#: Letters of a word from which on the library's heap of merges is the faster one.
LONG_WORD = 2000


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins across white space: each different word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocabulary, end = held["model"]["vocab"], held["model"]["end_of_word_suffix"]
        self.merges = Merges(vocabulary, merge_list(held))
        letters = {b: c for c, b in byte_letters().items()}
        self.inner, self.closing = (np.array([vocabulary[letters[b] + x] for b in range(256)], np.int64) for x in ("", end))
        self.memory = SpanMemory(lambda spans: self._encoded([w.decode() for w in spans]))

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): words of Latin letters by the merge list, their different pieces once; others by the library."""
        usual = np.array([(w.isascii() or (max(w) < LATIN_END and "\u0130" not in w)) and len(w) < LONG_WORD and not ODD.search(w) for w in words], bool)
        pieces = PARTS.findall("\n".join([*(w for w, u in zip(words, usual.tolist(), strict=True) if u), ""]).lower())
        places = {"\n": 0}
        at = np.array([places.setdefault(p, len(places)) for p in pieces], np.int64)
        spelled = [p.encode() for p in places][1:]
        sizes = np.array([len(b) for b in spelled], np.int64)
        letters = np.frombuffer(b"".join(spelled), np.uint8)
        last = np.zeros(len(letters), bool)
        last[np.cumsum(sizes) - 1] = True
        flat, bounds = self.merges.run(np.where(last, self.closing[letters], self.inner[letters]), sizes)
        #: The mark of a word's end has place 0 and no ids.
        starts, counts = np.append(0, bounds[:-1]), np.append(0, np.diff(bounds))
        n = counts[at]
        out = np.zeros(len(words), np.int64)
        out[usual] = np.diff(np.append(0, np.cumsum(n)[at == 0]))
        ids = flat[ranges(starts[at], n)]
        odd = np.flatnonzero(~usual)
        if len(odd):
            by_library = [np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, np.int64) for i in odd.tolist()]
            before = np.cumsum(out)[odd]
            ids = np.insert(ids, np.repeat(before, [len(x) for x in by_library]), np.concatenate(by_library))
            out[odd] = [len(x) for x in by_library]
        return ids, out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts; a null has none."""
        words = words_of(texts)
        ids, counts = self.memory.look(words)
        return ids, np.concatenate([[0], np.cumsum(counts)])[words.bounds]


class TournamentTree:
    """Bins in the order they were opened; each inner node holds the largest free room below it."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.free = [room] * (2 * self.size)

    def first_with(self, need: int) -> int:
        """The first bin with that much room. There is one."""
        i, free = 1, self.free
        while i < self.size:
            i *= 2
            if free[i] < need:
                i += 1
        return i - self.size

    def take(self, bin_: int, amount: int) -> None:
        i, free = bin_ + self.size, self.free
        free[i] -= amount
        i //= 2
        while i:
            a, b = free[2 * i], free[2 * i + 1]
            free[i] = a if a > b else b
            i //= 2


def pack(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, count) for documents of these many ids; one sequence at most isn't full."""
    full = [[(d, s, length)] for d, n in enumerate(sizes) for s in range(0, n - n % length, length)]
    items = sorted(((n % length, d) for d, n in enumerate(sizes) if n % length), key=lambda x: (-x[0], x[1]))
    tree, bins = TournamentTree(len(items), length), [[] for _ in items]
    for n, d in items:
        b = tree.first_with(n)
        tree.take(b, n)
        bins[b].append((d, sizes[d] - n, n))
    bins = sorted((b for b in bins if b), key=lambda b: -sum(x[2] for x in b))
    room = [length - sum(x[2] for x in b) for b in bins]
    to = next((i for i, r in enumerate(room) if r), len(bins))
    while to < len(bins) - 1:
        d, s, n = bins[-1].pop()
        move = min(n, room[to])
        bins[to].append((d, s, move))
        room[to] -= move
        room[-1] += move
        if n > move:
            bins[-1].append((d, s + move, n - move))
        if not bins[-1]:
            bins.pop()
            room.pop()
        while to < len(bins) and not room[to]:
            to += 1
    return full + bins


def _packed(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _packed.__dict__.setdefault(path, None) or WordTokenizer(path)
        _packed.__dict__[path] = tokenizer
        next_id = TaskContext.get().partitionId() << 36
        docs: list[int | None] = []
        ids: list[np.ndarray] = []

        def group() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            cols: list[list] = [[] for _ in range(7)]
            for pieces in pack([len(x) for x in ids], length):
                offset = 0
                for d, s, n in pieces:
                    for c, v in zip(cols, (docs[d], s, n, ids[d][s : s + n].tobytes(), len(ids[d]), next_id, offset), strict=True):
                        c.append(v)
                    offset += n
                next_id += 1
            types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            for i in range(0, len(cols[0]), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 1000], t) for c, t in zip(cols, types, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            docs.clear()
            ids.clear()

        tokens = 0
        for batch in slices(batches, "text", 2 << 20):
            flat, bounds = tokenizer.encode(batch.column("text"))
            for d, i, j in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                docs.append(d)
                ids.append(np.append(flat[i:j], END_ID).astype("<u4"))
                tokens += j - i + 1
                if len(docs) == GROUP_DOCS or tokens >= GROUP_TOKENS:
                    yield from group()
                    tokens = 0
        yield from group()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), one row for each piece of docs (doc_id, text, others).

    ids: little-endian unsigned 32-bit ids of the piece, which starts after start of its document's ids and stands at offset
    in its sequence; a document's ids end with END_ID, so a null or empty text has that one. Equal rows are documents of
    their own, a null doc_id stays null. An empty table gives no rows. The random deal is by row contents, so a task that
    runs again gets the same rows; sequence_id is the task's number times 2**36, and on."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    bounded_batches(docs.sparkSession)
    texts = keyed(docs).select("doc_id", "text")
    size = input_bytes(texts)
    #: Where the size isn't known, the input's own partitions say how much there is.
    parts = min(MOST_PARTITIONS, -(-size // PART_BYTES)) if size else texts.rdd.getNumPartitions()
    dealt = texts.repartition(max(1, parts)).sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id")
    return dealt.mapInArrow(_packed(tokenizer_path, length), PIECES)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
