"""Words and hashed word sequences of a text, as TESTDATA.md defines them.

A word is a longest run of letters and digits (categories L and N) after NFKC
normalization and lower-casing. Null and empty texts have no words.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_KEEP = 1 << 20


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(text.lower())


class _Ids(dict):
    """Word to 64-bit hash; the memory of one worker is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KEEP:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


_ids = _Ids()


def word_hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_ids.__getitem__, found), dtype=np.uint64, count=len(found))


def finalize(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sequences(hashes: np.ndarray, size: int, short: bool) -> np.ndarray:
    """Hashes of all runs of ``size`` words; with ``short``, a shorter text has one run: all its words."""
    n = len(hashes)
    if n < size:
        if not short or not n:
            return np.empty(0, dtype=np.uint64)
        size = n
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += hashes[k : n - size + 1 + k] ^ _MIX[k % len(_MIX)]
        out ^= out >> np.uint64(31)
    return finalize(out)


def triples(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of three consecutive words."""
    return np.unique(sequences(word_hashes(text), 3, short=True))
