"""Byte-level BPE as a streaming transducer with bounded lookahead, and decoding by an incremental byte-to-text machine.

A merge is undone by nothing, so once no text to come can change a token boundary, encoding what follows is a task of its
own. How far a change of the text can reach to the left is bounded by the merge list: a token t at hand, waiting to be
used by a merge, can be lost only if an earlier merge joins t, or the last part of t as it forms, to a token on its right,
which must have formed in turn. `lookahead` follows these chains of ever earlier merges once through the list. The encoder
reads the texts as one stream, a window at a time: it emits the tokens of every piece that has ended, and of the piece that
a window leaves open each token whose end lies the lookahead before what is known; the rest is held for the next window.
Its state doesn't grow with a text. Pieces are told apart by the vocabulary's public rule (letters, numbers, others, each with
a space before, contractions, white space), here as a scan over classes of code points. Ids of pieces are remembered."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .span_memory import SpanMemory
from .spark_tools import bounded_batches, keyed, read, slices
from .text_arrays import Words, ranges

#: Characters of a window, and ids that are decoded together.
WINDOW, BLOCK = 1 << 17, 1 << 16
#: The rank of a pair that never merges.
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_list(held: dict) -> list[tuple[str, str]]:
    """The merges of a vocabulary file, by rank; each is a pair or a text with a space."""
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that can decide whether it stays. Sound for merges applied by rank, leftmost first.

    reach[t]: the farthest that merges of t with a token on its right look, over the merges so far. inner[t]: the same for
    the last parts of t while t forms, when only merges before its own count. Merge (u, v) sees v and what v depends on."""
    reach: dict[bytes, int] = {}
    inner: dict[bytes, int] = {}
    for u, v in merges:
        depends = max(reach.get(v, 0), inner.get(v, 0))
        inner[u + v] = max(inner.get(u + v, 0), depends)
        reach[u] = max(reach.get(u, 0), len(v) + depends)
    return max([0, *reach.values(), *inner.values()])


class PairTable:
    """Ranks of pairs of ids by hashing: what collides in one table goes to the next."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        keys, ranks = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), np.arange(len(a))
        self.bits = max(8, (8 * len(a)).bit_length())
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        while len(keys):
            factor = np.uint64(pow(0x9E3779B97F4A7C15, 2 * len(self.tables) + 1, 1 << 64))
            at = keys * factor >> np.uint64(64 - self.bits)
            _, first = np.unique(at, return_index=True)
            held, rank = np.full(1 << self.bits, ~np.uint64(0)), np.zeros(1 << self.bits, np.int64)
            held[at[first]], rank[at[first]] = keys[first], ranks[first]
            self.tables.append((factor, held, rank))
            keys, ranks = np.delete(keys, first), np.delete(ranks, first)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        out = np.full(len(keys), NONE, np.int64)
        for factor, held, rank in self.tables:
            at = keys * factor >> np.uint64(64 - self.bits)
            found = held[at] == keys
            out[found] = rank[at[found]]
        return out


class Merges:
    """A merge list over a vocabulary of strings, applied to many pieces at once."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        ends = np.array([(vocabulary[a], vocabulary[b]) for a, b in merges])
        self.pairs = PairTable(ends[:, 0], ends[:, 1])
        self.merged = np.array([vocabulary[a + b] for a, b in merges])

    def run(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of pieces of so many ids, all at once: the lowest rank first, the leftmost of equals first."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done_ids, done_owner = [], []
        while len(ids):
            last = np.ones(len(ids), bool)
            last[:-1] = owner[1:] != owner[:-1]
            ranks = np.full(len(ids), NONE, np.int64)
            at = np.flatnonzero(~last)
            ranks[at] = self.pairs.ranks(ids[at], ids[at + 1])
            heads = np.flatnonzero(np.append(True, last[:-1]))
            least = np.minimum.reduceat(ranks, heads)
            least = np.repeat(least, np.diff(np.append(heads, len(ids))))
            ready = least == NONE
            if ready.any():
                done_ids.append(ids[ready])
                done_owner.append(owner[ready])
                ids, owner, ranks, least = (x[~ready] for x in (ids, owner, ranks, least))
            hits = ranks == least
            #: Equal pairs can overlap, as in "aaa"; of a run each second one merges.
            heads = hits.copy()
            heads[1:] &= ~hits[:-1]
            place = np.arange(len(hits))
            hits &= (place - np.maximum.accumulate(np.where(heads, place, 0))) % 2 == 0
            at = np.flatnonzero(hits)
            ids[at] = self.merged[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner = ids[keep], owner[keep]
        owner = np.concatenate([*done_owner, np.zeros(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([*done_ids, np.zeros(0, np.int64)])[order], np.searchsorted(owner[order], np.arange(len(sizes) + 1))


LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 4
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for run in regex.finditer(pattern, every):
                table[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind
        _classes.append(table)
    return _classes[0]


def piece_starts(points: np.ndarray, kind: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, contracted): where pieces begin in stretches of code points (heads: their starts, and the end), and where a
    contraction ended. Pieces are runs of a class, with one space before them; a contraction; white space up to its last
    character, which stands alone before others unless it is a space."""
    n = len(points)
    head, begin, contracted = (np.zeros(n + 1, bool) for _ in range(3))
    head[heads] = True
    begin[1:n] = kind[1:] != kind[:-1]
    begin |= head
    after = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~head[1:n]) + 1
    begin[after - 1] = True
    begin[after] = points[after - 1] != ord(" ")
    quotes = np.flatnonzero(points == ord("'"))
    quotes = quotes[begin[quotes] & ~head[quotes + 1]]
    next1 = points[quotes + 1]
    two = ~head[quotes + 2] if len(quotes) else np.zeros(0, bool)
    next2 = np.where(two, points[np.minimum(quotes + 2, n - 1)], 0)
    short = np.isin(next1, [ord(c) for c in "stmd"])
    long = np.zeros(len(quotes), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (next1 == ord(a)) & (next2 == ord(b))
    begin[quotes[short | long] + 1] = False
    begin[quotes[long] + 2] = False
    ends = np.append(quotes[short] + 2, quotes[long] + 3)
    begin[ends] = contracted[ends] = True
    return begin, contracted


def open_end(points: np.ndarray, kind: np.ndarray, begin: np.ndarray, contracted: np.ndarray) -> tuple[int, int]:
    """(hold, last) of a text that goes on: from hold on, more text can change where pieces begin; the piece from last to
    hold is open."""
    n = len(points)
    for i in range(max(n - 2, 0), n):
        if points[i] == ord("'") and begin[i] and (i == n - 1 or points[n - 1] in [ord(c) for c in "rvl"]):
            return i, i
    if contracted[n]:
        return n, n
    last = int(np.flatnonzero(begin[:n])[-1])
    hold = n - 1 if kind[n - 1] == WHITE else n
    return hold, min(last, hold)


class Transducer:
    """Encodes a stream of texts a window at a time. What is held back of a text at a window's end is bounded: a few
    characters that could still change how pieces part, and of an open piece the bytes whose tokens could still change."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocabulary = {to_bytes(s): i for s, i in held["model"]["vocab"].items()}
        pairs = merge_list(held)
        self.merges = Merges(held["model"]["vocab"], pairs)
        self.bytes = np.array([vocabulary[bytes([b])] for b in range(256)], np.int64)
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in held["added_tokens"]):
            raise ValueError("added tokens with conditions aren't supported")
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        table = {i: b for b, i in vocabulary.items()} | {i: s.encode() for s, i in self.added.items()}
        self.sizes = np.zeros(max(table) + 1, np.int64)
        for i, spelled in table.items():
            self.sizes[i] = len(spelled)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.spelled = np.frombuffer(b"".join(table.get(i, b"") for i in range(len(self.sizes))), np.uint8)
        self.lookahead = lookahead([(to_bytes(a), to_bytes(b)) for a, b in pairs])
        #: Bytes of one piece that are looked at together.
        self.span = 4 * (self.lookahead + int(self.sizes.max()))
        self.memory, self.window = SpanMemory(self._learn), WINDOW
        self.open_text()

    def open_text(self) -> None:
        """Nothing is held of the text to come: no characters, no bytes of an open piece, nor its class."""
        self.tail, self.rest, self.inside = "", b"", 0

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of short pieces."""
        return self.merges.run(self.bytes[np.frombuffer(b"".join(pieces), np.uint8)], np.array([len(p) for p in pieces], np.int64))

    def advance(self, piece: bytes, ends: bool) -> tuple[list[int], int]:
        """(ids, bytes used): the stable tokens of a piece so far, all if it ends here."""
        at, out = 0, []
        while at < len(piece):
            last = len(piece) - at <= self.span
            ids = self.merge([piece[at : at + self.span]])[0]
            if not (last and ends):
                ends_at = np.cumsum(self.sizes[ids])
                ids = ids[ends_at <= min(self.span, len(piece) - at) - self.lookahead]
            out += ids.tolist()
            at += int(self.sizes[ids].sum())
            if last:
                break
        return out, at

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of whole pieces: short ones together, each long one by its spans."""
        short = np.array([len(p) <= self.span for p in pieces], bool)
        flat, bounds = self.merge([p for p, s in zip(pieces, short.tolist(), strict=True) if s])
        counts = np.zeros(len(pieces), np.int64)
        counts[short] = np.diff(bounds)
        for i in np.flatnonzero(~short).tolist():
            ids = self.advance(pieces[i], True)[0]
            flat = np.insert(flat, int(counts[:i].sum()), ids)
            counts[i] = len(ids)
        return flat, counts

    def step(self, parts: list[str], goes_on: bool) -> list[np.ndarray]:
        """Stable ids of stretches of text. The first continues the text that is open, if one is; goes_on: the last stays open."""
        parts = [self.tail + parts[0], *parts[1:]]
        text, rest, inside = "".join(parts), self.rest, self.inside
        self.open_text()
        points = np.concatenate([np.zeros(len(rest), "<u4"), np.frombuffer(text.encode("utf-32-le"), "<u4")])
        kind = classes()[points]
        kind[: len(rest)] = inside
        n = len(points)
        heads = np.cumsum([len(rest), *map(len, parts)])
        heads[0] = 0
        begin, contracted = piece_starts(points, kind, heads)
        size = np.ones(n, np.int64) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.append(0, np.cumsum(size))
        data = np.frombuffer(rest + text.encode(), np.uint8)
        hold = last = n
        if goes_on and n > heads[-2]:
            hold, last = open_end(points, kind, begin, contracted)
            self.tail = text[hold - len(rest) :]
        first = np.flatnonzero(begin[:last])
        pieces = Words(data, np.zeros(0, np.int64), at[first], at[np.append(first[1:], last)] if len(first) else first, np.zeros(0, np.int64))
        ids, counts = self.memory.look(pieces)
        if last < hold:
            piece = data[at[last] : at[hold]].tobytes()
            more, used = self.advance(piece, False)
            self.rest, self.inside = piece[used:], int(kind[hold - 1])
            ids, counts, first = np.append(ids, np.array(more, np.int32)), np.append(counts, len(more)), np.append(first, last)
        ends = np.append(0, np.cumsum(counts))[np.searchsorted(first, heads)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Added tokens in it count as such, as by the library. Windows hold WINDOW characters, whatever
        texts they belong to; a text that a window cuts stays open."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts: list[tuple[int, str]] = []
        room = self.window

        def run(goes_on: bool) -> None:
            for (owner, _), ids in zip(parts, self.step([p for _, p in parts], goes_on), strict=True):
                out[owner].append(ids)
            parts.clear()

        self.open_text()
        for i, text in enumerate(texts):
            for stretch in self.split.split(text) if self.split else [text]:
                if stretch in self.added:
                    if parts:
                        run(False)
                    out[i].append(np.array([self.added[stretch]]))
                    continue
                at = 0
                while at < len(stretch):
                    parts.append((i, stretch[at : at + room]))
                    at += len(parts[-1][1])
                    room -= len(parts[-1][1])
                    if not room:
                        run(at < len(stretch))
                        room = self.window
        if parts:
            run(False)
        return [np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in out]

    def decode(self, blocks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of ids that come block by block; bytes of an unfinished character wait, wrong ones become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            yield machine.decode(self.spelled[ranges(self.starts[ids], self.sizes[ids])].tobytes())
        yield machine.decode(b"", True)


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = machine(path)
        for batch in slices(batches, "text", 1 << 20):
            ids = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            texts = ["".join(bpe.decode(x[i : i + BLOCK] for i in range(0, len(x), BLOCK))) for x in ids]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode_and_decode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded), one row for each row of docs (doc_id, text and any others): its ids and their text.

    A null text counts as empty: no ids, decoded is empty. Nothing is shuffled; an empty table gives no rows."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    bounded_batches(docs.sparkSession)
    return keyed(docs).select("doc_id", "text").mapInArrow(_round_trip(tokenizer_path), "doc_id long, ids array<int>, decoded string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_and_decode(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
