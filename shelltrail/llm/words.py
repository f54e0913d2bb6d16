"""Words of many texts as 64-bit hashes in flat arrays."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

# Bytes of words whose hashes a worker remembers, about; it starts afresh when it knows more.
KNOWN_BYTES = 5 << 23
_lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of the blank-separated words of texts, A-Z lowered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.size = 0

    def __call__(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All word hashes one text after another, and the number of words of each text."""
        words = [t.encode().translate(_lower).split() for t in items]
        known = self.known
        if self.size > KNOWN_BYTES:
            known.clear()
            self.size = 0
        for w in set(chain.from_iterable(words)).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
            self.size += 150 + len(w)
        counts = np.array([len(w) for w in words], np.int64)
        look = known.__getitem__
        flat = np.fromiter(map(look, chain.from_iterable(words)), np.uint64, counts.sum())
        return flat, counts


def grams(flat: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from every place on, and whether they lie in one text."""
    n = len(flat)
    out = np.zeros(n, np.uint64)
    # fewer words than a gram has: none lies inside
    for k in range(min(size, n)):
        out[: n - k] = mix(out[: n - k] + flat[k:] + np.uint64(0x9E3779B97F4A7C15))
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)
    return out, left >= size
