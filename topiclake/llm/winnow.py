"""Winnowing: of every ``window`` consecutive k-grams of words, the one with the least hash is kept.

Two texts that share ``k + window - 1`` consecutive words keep a common fingerprint there, because
they see the same window of hashes and take the same one (the rightmost among equals).
"""

from __future__ import annotations

import numpy as np

from topiclake.llm.text import Words, gram_hashes, within


def winnow(words: Words, hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all texts: (first word of each kept k-gram, hash of it), in order.

    Texts with fewer than ``k + window - 1`` words have none.
    """
    grams = gram_hashes(hashes, k)
    full = within(words, k + window - 1)
    size = len(full)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:size].copy()
    at = np.arange(size)
    for i in range(1, window):
        other = grams[i : i + size]
        less = other <= least
        least[less] = other[less]
        at[less] = np.flatnonzero(less) + i
    at = at[full]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return at, grams[at]


def split_span(words: int) -> tuple[int, int]:
    """k and window that together cover exactly a span of so many words."""
    k = (words + 1) // 2
    return k, words + 1 - k
