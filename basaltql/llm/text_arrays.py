"""Words of many texts at once as numpy arrays: byte spans, 64-bit hashes, rolling n-gram hashes.

A word is `[^\\x20\\x09-\\x0D]+`. Its bytes are read eight at a time; a tree of mixing steps folds them into its hash, so no
arithmetic relation between words gives equal hashes. Spans of words are polynomials over the words' hashes modulo the prime
2**61 - 1, with a final mix. All is the same on every machine. A batch should hold a few MB: the tables of powers grow to its
size."""

from __future__ import annotations

import dataclasses
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

U = np.uint64
PRIME = (1 << 61) - 1
P, LOW = U(PRIME), U((1 << 32) - 1)
BASE = 0x1B3A5C7D9E8F6241 % PRIME
BASE_INVERSE = pow(BASE, -1, PRIME)
SPAN_SALT = U(0x632BE59BD9B4E019)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_tables: dict[int, np.ndarray] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & P) + (x >> U(61))
    return np.where(x >= P, x - P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for a and b below it: products of 32-bit halves, where 2**61 counts as 1."""
    a_low, a_high, b_low, b_high = a & LOW, a >> U(32), b & LOW, b >> U(32)
    low, middle = a_low * b_low, a_low * b_high + a_high * b_low
    return reduced((a_high * b_high << U(3)) + (middle >> U(29)) + ((middle & U((1 << 29) - 1)) << U(32)) + (low & P) + (low >> U(61)))


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b modulo PRIME."""
    return np.where(a >= b, a - b, a + P - b)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE, or its inverse, to the powers 0 to n - 1 modulo PRIME."""
    base = BASE_INVERSE if inverse else BASE
    table = _tables.get(base, np.ones(1, U))
    while len(table) < n:
        table = np.concatenate([table, times(table, U(pow(base, len(table), PRIME)))])
        _tables[base] = table
    return table[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """sums[i] covers values[:i], each times BASE to its place, modulo PRIME."""
    terms = times(reduced(values), powers(len(values)))
    high, sums = np.cumsum(terms >> U(32)), np.zeros(len(values) + 1, U)
    sums[1:] = reduced((high >> U(29)) + ((high & U((1 << 29) - 1)) << U(32)) + np.cumsum(terms & LOW))
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of the values behind sums: equal for equal contents, wherever they are."""
    return mix(times(minus(sums[ends], sums[starts]), powers(len(sums), inverse=True)[starts]) + SPAN_SALT)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ..."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def folded(values: np.ndarray, counts: np.ndarray, salt: int) -> np.ndarray:
    """One value for each group of neighbouring values (counts[i] of them, one at least): pairs of neighbours are mixed into
    one, level by level, and the group's size last."""
    out = np.zeros(len(counts), U)
    group, sizes = np.arange(len(counts)), counts.copy()
    while len(group):
        first = np.cumsum(sizes) - sizes
        one = sizes == 1
        out[group[one]] = values[first[one]]
        group, first, sizes = group[~one], first[~one], sizes[~one]
        half = (sizes + 1) // 2
        left = 2 * ranges(np.zeros(len(half), np.int64), half) + np.repeat(first, half)
        alone = left + 1 == np.repeat(first + sizes, half)
        right = np.where(alone, U(salt), values[np.minimum(left + 1, len(values) - 1)]) if len(left) else values[:0]
        values, sizes = mix(values[left] * U(3) + mix(right + U(salt))), half
    return mix(out + mix(counts.astype(U) + U(salt)))


def eights(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts): the bytes of each span as 64-bit values, the last one filled with zeros."""
    sizes = ends - starts
    counts = (sizes + 7) >> 3
    padded = np.zeros((len(data) + 23) // 8 * 8, np.uint8)
    padded[: len(data)] = data
    whole = padded.view("<u8")
    last = np.cumsum(counts) - 1
    at = np.repeat(starts - 8 * (last + 1 - counts), counts) + 8 * np.arange(int(counts.sum()))
    shift = ((at & 7) << 3).astype(U)
    values = whole[at >> 3] >> shift | whole[(at >> 3) + 1] << U(1) << (U(63) - shift)
    values[last] &= ~U(0) >> ((8 * counts - sizes) << 3).astype(U)
    return values, counts


@dataclasses.dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    texts: np.ndarray  # offsets of the texts in data
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    bounds: np.ndarray  # words of text i: bounds[i] to bounds[i + 1]

    @functools.cached_property
    def eights(self) -> tuple[np.ndarray, np.ndarray]:
        return eights(self.data, self.starts, self.ends)

    def hashed(self, salt: int) -> np.ndarray:
        """A hash of each word; hashes by different salts are independent."""
        values, counts = self.eights
        return folded(mix(values + U(salt)), counts, salt) ^ (self.ends - self.starts).astype(U)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return self.hashed(0xD6E8FEB86659FD93)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def sums(self) -> np.ndarray:
        return prefix_sums(self.hashes)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is empty."""
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """All words of the texts, in order. lower: A-Z count as a-z."""
    data, offsets = raw(texts)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def grams(words: Words, n: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, places, counts) of the n-word windows inside the texts: the place is the first word's."""
    counts = np.maximum(words.counts() - n + 1, 0)
    places = ranges(words.bounds[:-1], counts)
    sums = words.sums() if sums is None else sums
    return span_hash(sums, places, places + n), places, counts
