"""Hashes of the words and shingles of whole texts, in bulk."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words, and their bytes, that a worker remembers before it starts anew.
MEMO_WORDS, MEMO_BYTES = 200_000, 10_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


class _Memo(dict):
    """word -> 64-bit hash; hashes each word once."""

    used = 0

    def __missing__(self, word: bytes) -> int:
        self.used += len(word)
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_memo = _Memo()


def memo() -> _Memo:
    """The worker's memo, started anew when it has grown to its bound."""
    global _memo
    if len(_memo) > MEMO_WORDS or _memo.used > MEMO_BYTES:
        _memo = _Memo()
    return _memo


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the `[^\\x20\\x09-\\x0D]+` of the text (as bytes.split())."""
    words = text.split()
    return np.fromiter(map(memo().__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (splitmix64's last steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's `width`-word shingles, A-Z folded;
    with fewer words the whole sequence is one; none without words."""
    w = word_hashes((text or b"").lower())
    n = len(w)
    if n == 0:
        return w
    k = min(width, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = h * _P + w[j : n - k + 1 + j]
    return np.unique(mix(h))
