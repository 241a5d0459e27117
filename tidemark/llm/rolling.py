"""Vectorised rolling hashes over words and bytes, and content-chosen anchors.

Arithmetic is modulo 2**64 on numpy arrays. A string's hash is a polynomial in an odd base, so a
prefix array gives the hash of any range in constant time.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
MAX = U(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15  # odd
_INVERSE = pow(BASE, -1, 1 << 64)
_LOW = U(0xFFFFFF)  # a position within one batch: below 2**24

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> U(31))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xA0761D6478BD642F)
    return x ^ (x >> U(29))


BYTE = mix(np.arange(1, 257, dtype=U) * U(BASE))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int, which: str = "up") -> np.ndarray:
    if len(_powers[which]) < n:
        size = max(n, 2 * len(_powers[which]))
        table = np.full(size, U(BASE if which == "up" else _INVERSE))
        table[0] = U(1)
        _powers[which] = np.cumprod(table, dtype=U)
    return _powers[which][:n]


class Prefix:
    """Hashes of ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * powers(n), out=self.sums[1:])
        self.down = powers(n + 1, "down")

    def range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def word_bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no ASCII white space."""
    flags = np.ones(len(a) + 2, np.int8)
    flags[1:-1] = SPACE[a]
    edges = np.flatnonzero(np.diff(flags))
    return edges[0::2], edges[1::2]


def word_hashes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where it starts."""
    start, end = word_bounds(a)
    return Prefix(BYTE[a]).range(start, end), start


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, MAX)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchored_runs(values: np.ndarray, owner: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Split all windows inside one owner into runs that share an anchor.

    A window's anchor is its leftmost ``gram``-gram with the least hash. It depends on the
    window's content alone, so equal windows lie at the same offset of equal anchors. A run is
    a maximal series of windows with one anchor: ``start`` its first window, ``count`` windows,
    ``offset`` from that start to the anchor, ``anchor`` hash, ``extent`` hash of all its values.
    """
    n = len(values)
    none = {k: np.zeros(0, U if k in ("anchor", "extent") else np.int64) for k in ("start", "count", "offset", "anchor", "extent")}
    if n < window:
        return none
    prefix = Prefix(values)
    at = np.arange(n - gram + 1)
    grams = prefix.range(at, at + gram)
    least = sliding_min((grams & ~_LOW) | at.astype(U), window - gram + 1)
    anchor = (least & _LOW).astype(np.int64)
    inside = owner[: n - window + 1] == owner[window - 1 :]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return none
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    last = np.flatnonzero(ends)
    spot = anchor[start]
    return {"start": start, "count": last - start + 1, "offset": spot - start, "anchor": grams[spot],
            "extent": prefix.range(start, last + window)}


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n places are covered by the windows that start there."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges[:-1]) > 0
