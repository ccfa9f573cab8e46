"""Words of a text and their hashes, inside tasks.

A word is a run of characters other than the six ASCII white-space characters. ``bytes.split``
splits on just these, and none of them is part of a longer UTF-8 sequence.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Entries of a per-task memo; it starts anew when full, so memory stays bounded.
MEMO = 400_000


class WordHashes(dict):
    """Memo from a word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def lower_words(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER).split() if text else []


def word_hashes(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` words; empty with fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(hashes[i : i + m] + np.uint64(i + 1))
    return mix(out)
