"""Words and shingles of a text, for code that runs inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MEMO = 300_000
SHINGLE = 5


def words(text: str | None) -> list[bytes]:
    """The words of ``text``: A-Z lower-cased, parted by the bytes 09-0D and 20; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_FACTORS = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``width`` words, in order; of all words at once when there are fewer; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out += hashes[k : n - width + 1 + k] * _FACTORS[k % 64]
    return mix(out + np.uint64(width))
