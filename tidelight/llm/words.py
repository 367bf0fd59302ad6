"""Words of a text and their hashes: the words are runs of bytes other than ASCII white space."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries of a worker's memo of word hashes before it is emptied.
MEMO_ENTRIES = 1 << 18
U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


#: A worker's memo, shared by its tasks.
HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves every bit of the result."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words; none where there are fewer."""
    if len(hashes) < n:
        return np.empty(0, U)
    out = np.zeros(len(hashes) - n + 1, U)
    for k in range(n):
        out = out * U(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
        out ^= out >> U(29)
    return mix(out)
