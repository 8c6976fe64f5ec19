"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

KNOWN_CHARS = 1_500_000
"""Characters of the words that are remembered."""
LONG = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Distinct shingles of `size` words of a text, with their counts. Remembers word hashes; that changes speed only."""

    def __init__(self, size: int = 5):
        self.size, self.known, self.chars = size, {}, 0

    def words(self, text: str) -> np.ndarray:
        words = text.split()
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            pass
        if self.chars > KNOWN_CHARS:
            known.clear()
            self.chars = 0
        own = {}
        for w in words:
            if w not in known and w not in own:
                if len(w) > LONG:
                    own[w] = xxhash.xxh64_intdigest(w)
                else:
                    known[w] = xxhash.xxh64_intdigest(w)
                    self.chars += len(w)
        return np.fromiter((known[w] if w in known else own[w] for w in words), np.uint64, len(words))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text of fewer words is one shingle; a text without words has none."""
        h = self.words(text)
        n = max(len(h) - self.size + 1, min(len(h), 1))
        out = np.zeros(n, np.uint64)
        for i in range(min(self.size, len(h))):
            out = (out ^ h[i : i + n]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out, return_counts=True)
