"""What a function gives for byte spans, such as the ids of words, remembered in sorted arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .text_arrays import U, Words, ranges

#: Spans, and bytes of them in eights, that a worker remembers. The memory only saves work: when full it starts anew.
MOST_SPANS, MOST_EIGHTS = 1_000_000, 4_000_000


class SpanMemory:
    """Values (lists of ids) of spans. A span is found by its hash and accepted only if all its bytes are the same."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        """learn: (ids, counts) of different spans, one after the other."""
        self.learn = learn
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.eights = np.zeros(0, U), np.zeros(0, U)
        self.ids = np.zeros(0, np.int32)
        self.starts, self.counts, self.sizes, self.places = (np.zeros(0, np.int64) for _ in range(4))

    def _add(self, spans: Words, new: np.ndarray, at: np.ndarray) -> None:
        """Learns the spans of these indices; at: where their hashes belong."""
        values, counts = spans.eights
        places = (np.cumsum(counts) - counts)[new]
        ids, n = self.learn([spans.data[a:b].tobytes() for a, b in zip(spans.starts[new].tolist(), spans.ends[new].tolist(), strict=True)])
        self.hashes = np.insert(self.hashes, at, spans.hashes[new])
        self.sizes = np.insert(self.sizes, at, (spans.ends - spans.starts)[new])
        self.starts = np.insert(self.starts, at, len(self.ids) + np.cumsum(n) - n)
        self.counts = np.insert(self.counts, at, n)
        self.places = np.insert(self.places, at, len(self.eights) + np.cumsum(counts[new]) - counts[new])
        self.eights = np.concatenate([self.eights, values[ranges(places, counts[new])]])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def look(self, spans: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the spans, one after the other."""
        if not len(spans.starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.hashes) > MOST_SPANS or len(self.eights) > MOST_EIGHTS:
            self._clear()
        hashes, first, place = np.unique(spans.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero(hashes != np.append(self.hashes, U(0))[at]) if len(self.hashes) else np.arange(len(hashes))
        #: 0 stands beyond the last hash; a span that really hashes to it counts as known only if it is.
        if len(self.hashes):
            beyond = (at == len(self.hashes)) & (hashes == U(0))
            new = np.union1d(new, np.flatnonzero(beyond))
        if len(new):
            self._add(spans, first[new], at[new])
            at = np.searchsorted(self.hashes, hashes)
        at = at[place]
        starts, counts, pool = self.starts[at], self.counts[at], self.ids
        other = self._unlike(spans, at)
        if len(other):
            ids, n = self.learn([spans.data[a:b].tobytes() for a, b in zip(spans.starts[other].tolist(), spans.ends[other].tolist(), strict=True)])
            starts[other], counts[other] = len(pool) + np.cumsum(n) - n, n
            pool = np.concatenate([pool, ids.astype(np.int32)])
        return pool[ranges(starts, counts)], counts

    def _unlike(self, spans: Words, at: np.ndarray) -> np.ndarray:
        """Indices of spans whose bytes aren't those remembered under their hash."""
        values, counts = spans.eights
        unlike = self.sizes[at] != spans.ends - spans.starts
        short = np.where(unlike, 0, counts)
        owner = np.repeat(np.arange(len(at)), short)
        own = values if not unlike.any() else values[np.repeat(~unlike, counts)]
        unlike[owner[own != self.eights[ranges(self.places[at], short)]]] = True
        return np.flatnonzero(unlike)
