"""Hashed word-shingle sets of documents: what the n-gram Jaccard join works on."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a task remembers before it starts anew.
CACHE_WORDS = 500_000
#: Any odd constants: they spread sums of word hashes over 64 bits.
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """64-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words part at ASCII white space. Bytes know exactly these two ASCII rules."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, known: Words, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of all words as one if they are fewer; empty without words."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    if len(known) > CACHE_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    k = min(n, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out + h[j : len(w) - k + 1 + j]) * FACTOR
        out ^= out >> np.uint64(29)
    return np.unique(out * SPREAD)


def digest(hashes: np.ndarray, seed: int = 0) -> bytes:
    """128-bit digest of a set."""
    return xxhash.xxh3_128_digest(hashes.tobytes(), seed)
