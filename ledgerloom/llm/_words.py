"""Word and shingle hashes for the operators that run in Arrow batches. Words: runs without white space, A-Z lower-cased."""

from __future__ import annotations

import numpy as np

from ._base import ship

ship(__name__)

#: Words whose hashes a worker remembers at most.
MOST_REMEMBERED = 500_000


def word_hasher():
    """A function from text (str or None) to the uint64 hashes of its words."""
    from xxhash import xxh3_64_intdigest

    class Seen(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = h = xxh3_64_intdigest(word)
            return h

    seen = Seen()

    def hashes(text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, in case and white space
        if len(seen) > MOST_REMEMBERED:
            seen.clear()
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))

    return hashes


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    start = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    return mixed(start) | np.uint64(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all shingles in order; fewer words than size are one shingle; no words, none."""
    n = len(words)
    if not n:
        return words
    by = odd_numbers(size, 17)
    if n < size:
        with np.errstate(over="ignore"):
            return mixed(np.array([(words * by[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    out = words[: n - size + 1] * by[0]
    for j in range(1, size):
        out += words[j : n - size + 1 + j] * by[j]
    return mixed(out)
