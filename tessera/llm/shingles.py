"""Word hashes and shingle sets, with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """Word -> 64-bit hash, for so many words at a time."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= 150_000:
                self.clear()
            self[word] = found
        return found


def word_hashes(text: str | None, memo: WordHashes) -> np.ndarray:
    """One hash per word of the text, A-Z lower-cased; words are runs without ASCII white space."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = mix(h * _STEP + words[i : i + n] + np.uint64(i + 1))
    return h


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; of fewer words, the whole sequence is the one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(grams(words, min(width, len(words)))) + np.uint64(0 if len(words) >= width else len(words))
