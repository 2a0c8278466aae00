"""Word shingles of whole texts as sets of 64-bit hashes, and their minima."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .rolling import grouped, mixed, word_hashes

SHINGLE_WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _combined(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words."""
    n = len(words) - width + 1
    h = words[:n].copy()
    for i in range(1, width):
        h *= _STEP
        h += words[i : i + n]
    return mixed(h + np.uint64(width))


def shingle_sets(texts: list[bytes | None], size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct ``size``-word shingles of each text; A-Z in lower case.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    raws = [(t or b"").lower() for t in texts]
    for a, b in grouped(raws):
        part = raws[a:b]
        words, places = word_hashes(b" ".join(part))
        first = np.cumsum([0] + [len(t) + 1 for t in part])
        bounds = np.searchsorted(places, first)
        whole = _combined(words, size) if len(words) >= size else words[:0]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= size:
                yield np.unique(whole[lo : hi - size + 1])
            elif hi > lo:
                yield _combined(words[lo:hi], hi - lo)
            else:
                yield words[:0]


def set_key(s: np.ndarray) -> bytes | None:
    """128 bits that name a set; none for the empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


class MinHashes:
    """``count`` functions of a strongly universal family (multiply, add, shift)."""

    def __init__(self, count: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 64, count, np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 64, count, np.uint64)

    def of(self, s: np.ndarray) -> np.ndarray:
        """Minimum of every function over a set, as unsigned 32 bits."""
        x = s & np.uint64(0xFFFFFFFF)
        out = np.full(len(self.a), np.uint32(0xFFFFFFFF))
        for i in range(0, len(x), 1024):
            h = x[i : i + 1024] * self.a[:, None]
            h += self.b[:, None]
            out = np.minimum(out, (h.min(axis=1) >> np.uint64(32)).astype(np.uint32))
        return out
