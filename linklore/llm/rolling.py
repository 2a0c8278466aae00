"""Hashes of words and character runs of whole texts, from prefix sums over their bytes.

With random odd ``C`` and a random 64-bit number for each byte, the hash of the bytes
from s to e is the sum of number * C**position, moved to position 0.  Differences of a
running sum (modulo 2**64) give it for any run, so a batch of texts takes a few numpy
passes and no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_SPACES = b" \t\n\r\x0b\x0c"
_rng = np.random.default_rng(20)
_C = int(_rng.integers(0, 1 << 63)) * 2 + 1
_NUMBER = _rng.integers(0, 1 << 64, 256, np.uint64)
#: Bytes hashed at a time.
SEGMENT = 1 << 20
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """C**i and its inverse for i below n."""
    n = max(n, SEGMENT)
    if n not in _tables:
        up, down = np.full(n, np.uint64(_C)), np.full(n, np.uint64(pow(_C, -1, 1 << 64)))
        up[0] = down[0] = 1
        made = np.cumprod(up), np.cumprod(down)
        if n > SEGMENT:
            return made
        _tables[n] = made
    return _tables[n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Prefix sums over one segment."""

    def __init__(self, segment: np.ndarray):
        up, self.down = _powers(len(segment))
        self.sums = np.zeros(len(segment) + 1, np.uint64)
        np.cumsum(_NUMBER[segment] * up[: len(segment)], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``starts`` to ``ends`` (exclusive)."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def segments(raw: bytes) -> Iterator[tuple[int, int]]:
    """Cuts at white space, so that no word is divided."""
    at = 0
    while at < len(raw):
        end = min(at + SEGMENT, len(raw))
        if end < len(raw):
            back = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if back > at:
                end = back
            else:
                ahead = [i for c in _SPACES if (i := raw.find(c, end)) >= 0]
                end = min(ahead, default=len(raw))
        yield at, end
        at = end


def word_bounds(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a segment."""
    inside = np.zeros(len(segment) + 2, np.int8)
    inside[1:-1] = ~SPACE[segment]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word (run of anything but ASCII white space)."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    data = np.frombuffer(raw, np.uint8)
    for at, end in segments(raw):
        starts, ends = word_bounds(data[at:end])
        hashes.append(Prefixes(data[at:end]).runs(starts, ends))
        places.append(starts + at)
    return np.concatenate(hashes), np.concatenate(places)


def grouped(texts: list[bytes], most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together; a longer text is alone."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)
