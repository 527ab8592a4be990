"""Words, lines and windows that simple polynomial hashes confuse, and what happens if two hashes really are equal."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from basaltql.llm import line_dedup, near_dedup, packing, substring_dedup, text_arrays
from basaltql.llm.span_memory import SpanMemory

OTHER = str.maketrans("ab", "ba")


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.fixture(scope="module")
def texts():
    out = []
    for n in (1024, 2048, 4096):
        out += [thue_morse(n), thue_morse(n).translate(OTHER), " ".join(thue_morse(n)), " ".join(thue_morse(n).translate(OTHER))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


def test_arithmetic_is_that_of_the_prime():
    rng = np.random.default_rng(0)
    a, b = (np.append(rng.integers(0, text_arrays.PRIME, 500, dtype=np.uint64), np.array([0, text_arrays.PRIME - 1], np.uint64)) for _ in range(2))
    assert text_arrays.times(a, b).tolist() == [int(x) * int(y) % text_arrays.PRIME for x, y in zip(a, b, strict=True)]
    sums, total = text_arrays.prefix_sums(a), 0
    for i, x in enumerate(a.tolist()):
        total = (total + x * pow(text_arrays.BASE, i, text_arrays.PRIME)) % text_arrays.PRIME
        assert int(sums[i + 1]) == total


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in packing.pack_documents(docs).collect():
        ids = np.array(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [1], "<u4")
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)


def test_near_duplicates(docs, texts):
    assert all(r.kept or len(texts[r.component_id].split()) > 1 for r in near_dedup.near_duplicates(docs).collect() if len(texts[r.doc_id].split()) == 1)


def test_substrings(docs, texts):
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        expected[i] = (len(w), sum(gone))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect()} == expected


def test_lines(docs, texts):
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in line_dedup.line_dedup(docs, line_dedup.EVERY_LINE).collect()}
    assert got == {i: (0, t) for i, t in enumerate(texts)}


def test_equal_hashes_are_no_equal_words(monkeypatch):
    monkeypatch.setattr(text_arrays.Words, "hashes", property(lambda self: np.zeros(len(self.starts), np.uint64)))
    memory = SpanMemory(lambda spans: (np.concatenate([np.frombuffer(s, np.uint8) for s in spans]).astype(np.int64), np.array([len(s) for s in spans])))
    for text in ("one two one three", "three four fourteencharacters fourteencharacterz two"):
        words = text_arrays.words_of(pa.array([text]))
        ids, counts = memory.look(words)
        assert bytes(ids.astype(np.uint8)) == text.replace(" ", "").encode() and counts.tolist() == [len(w) for w in text.split()]


def test_equal_hashes_are_no_equal_lines(spark, monkeypatch):
    """The lines' first hash is the same for all; the second tells them apart."""
    monkeypatch.setattr(line_dedup, "span_hash", lambda sums, a, b: np.zeros(len(a), np.uint64))
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1], "text_hash": [7, 8], "text": ["first line\nsecond line", "third line\nfirst line"]})
    out = [r for b in line_dedup._lines(1)([batch]) for r in b.to_pylist()]
    assert len({r["print"] for r in out if r["hash"] is not None}) == 3
