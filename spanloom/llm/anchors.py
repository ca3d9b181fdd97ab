"""Anchors cut texts into segments such that equal strings of a given length fall into segments with equal anchors.

The anchor of a string of `width` bytes is its leftmost GRAM-byte piece with the smallest hash. It depends on the string alone, so equal strings have
equal anchors at equal places, wherever they are. Neighbouring strings mostly share one; a segment stands for all strings that start next to each other
and have one anchor.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

GRAM = 64
#: Bytes of a text that are looked at in one go; their positions must fit into POSITION bits.
CHUNK, POSITION = 1 << 19, 20
#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Segments(NamedTuple):
    anchor: np.ndarray  # hash of the anchor
    start: np.ndarray  # where the first of its strings starts
    count: np.ndarray  # how many strings, starting one after the other
    offset: np.ndarray  # from start to the anchor


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Cutter:
    def __init__(self, width: int) -> None:
        if width < GRAM:
            raise ValueError(f"strings must have {GRAM} bytes at least")
        self.width = width
        self.up, self.down = _powers(BASE, CHUNK + width), _powers(INVERSE, CHUNK + width)

    def __call__(self, data: bytes) -> Segments:
        parts = [self._chunk(np.frombuffer(data, np.uint8)[at : at + CHUNK + self.width - 1], at) for at in range(0, max(0, len(data) - self.width + 1), CHUNK)]
        if not parts:
            return Segments(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64)))
        anchor, start, count, offset = map(np.concatenate, zip(*parts, strict=True))
        # a segment that a chunk's border cuts in two is put together again
        first = np.flatnonzero(np.concatenate([[True], np.diff(start + offset) != 0]))
        return Segments(anchor[first], start[first], np.add.reduceat(count, first), offset[first])

    def _chunk(self, data: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        grams = (sums[GRAM:] - sums[:-GRAM]) * self.down[: n - GRAM + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
        low = (grams & ~np.uint64((1 << POSITION) - 1)) | np.arange(len(grams), dtype=np.uint64)
        reach, size = self.width - GRAM + 1, 1
        while size * 2 <= reach:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if reach > size:
            low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
        where = (low & np.uint64((1 << POSITION) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        count = np.diff(np.concatenate([first, [len(where)]]))
        return grams[where[first]], first + at, count, where[first] - first
