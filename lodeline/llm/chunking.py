"""Content-defined chunk boundaries by a gear rolling hash, vectorised over a flat buffer of texts.

The gear hash of a place covers the `window` bytes up to it: h = sum(gear[byte] << age * 32 / window), so its high bits
depend on all of them. It is built by doublings. A chunk ends where the hash falls below 2**32 / average; the first bytes of
a text, up to a window, hold no such place, so equal stretches of different texts are cut alike wherever they stand. A chunk longer than
`longest` is cut every `longest` bytes.
"""

from __future__ import annotations

import numpy as np

_GEAR = np.random.default_rng(20260102).integers(0, 2**32, 256, dtype=np.uint32)
WINDOW = 32


def gear(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    h, s = _GEAR[data], 1
    while s < window:
        step = h[:-s] << np.uint32(s * 32 // window)
        h[s:] += step
        s *= 2
    return h


def boundaries(data: np.ndarray, offsets: np.ndarray, average: int, longest: int, characters: bool = False, window: int = WINDOW) -> np.ndarray:
    """Ascending ends of the chunks of all texts; ends of texts are among them, and no chunk is empty.

    characters: no cut within a UTF-8 character (a forced cut moves on to the next one).
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(gear(data, window) < np.uint32(min(2**32 - 1, 2**32 // average))) + 1
    row = np.searchsorted(offsets, ends - 1, "right") - 1
    ends = ends[ends - offsets[row] >= window]
    if characters:
        ends = ends[(ends == n) | ((data[np.minimum(ends, n - 1)] & 0xC0) != 0x80)]
    ends = np.union1d(ends, offsets[1:][offsets[1:] > 0])
    gaps = np.diff(ends, prepend=0)
    more = (gaps - 1) // longest
    if more.any():
        base = np.repeat(ends - gaps, more)
        nth = np.arange(len(base)) - np.repeat(np.cumsum(more) - more, more) + 1
        forced = base + nth * longest
        if characters:
            for _ in range(3):
                forced += (forced < n) & ((data[np.minimum(forced, n - 1)] & 0xC0) == 0x80)
        ends = np.union1d(ends, forced)
    return ends
