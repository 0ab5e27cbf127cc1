"""Content-set positions of byte strings.

Every window of `width` bytes has one anchor: the place of the least hash among the
grams of GRAM bytes inside it, leftmost on a tie. Equal windows have their anchor at
the same distance from their start, wherever they stand; windows that follow each
other mostly share one. So the anchors stand for all windows at a few per cent of
their number.
"""

from __future__ import annotations

import numpy as np

GRAM = 32
#: Fixed seed of the byte values and the odd base of the rolling sums (modulo 2**64).
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def gram_sums(data: np.ndarray) -> np.ndarray:
    """Rolling sum of the GRAM bytes from each place, by doubling (data: uint8)."""
    sums, base, step = _VALUES[data], _BASE, 1
    while step < GRAM:
        sums = sums[:-step] * np.uint64(base) + sums[step:]
        base, step = base * base & _WORD, 2 * step
    return sums


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)


_powers = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[i]: of data[:i], each byte's value times the base to the power of its place."""
    _powers.need(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers.up[: len(data)], out=out[1:])
    return out


def span_sums(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of data[start:end], as if it began at 0: equal for equal strings."""
    return (prefix[end] - prefix[start]) * _powers.down[start]


def windows_by_anchor(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a string of at least width bytes: anchors, the first and last window start
    that each is the anchor of, and the sums of the anchors' grams."""
    sums = gram_sums(data)
    mixed = sums ^ (sums >> np.uint64(29))
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
    key = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(sums), dtype=np.uint64)
    span, reach = width - GRAM + 1, 1
    while 2 * reach <= span:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < span:
        key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    anchor = at[first]
    return anchor, first, last, sums[anchor]
