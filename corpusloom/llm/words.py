"""Words of long texts in parts, and hashes of runs of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: code points that part words
BLANKS = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)
BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: bytes of a text that are cut into words at a time
PART = 1 << 20
#: an odd multiplier, and its inverse modulo 2^64
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: powers that are kept; those of longer texts are made when needed
KEPT = 1 << 18
_POWERS: list[np.ndarray] = []


def parts(text: str) -> Iterator[list[bytes]]:
    """The words of a text, part by part, so that those of a very long text are never held together."""
    raw, at = text.encode("utf-8", "surrogatepass"), 0
    while at < len(raw):
        blank = BLANK.search(raw, at + PART)
        end = blank.start() if blank else len(raw)
        yield raw[at:end].split()
        at = end


def _made(n: int) -> list[np.ndarray]:
    """The first n powers of BASE and INVERSE."""
    out = []
    for x in (BASE, INVERSE):
        steps = np.full(n, x, dtype=np.uint64)
        steps[:1] = 1
        out.append(np.cumprod(steps, dtype=np.uint64, out=steps))
    return out


def _powers(n: int) -> list[np.ndarray]:
    if n > KEPT:
        return _made(n)
    if not _POWERS:
        _POWERS.extend(_made(KEPT))
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


class Runs:
    """Hashes of runs of a text's words, by their content alone."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power, self.inverse = _powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed(words.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)
        return x ^ (x >> np.uint64(32))
