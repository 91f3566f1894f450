"""Edit distance of two strings by bit-parallel columns on Python's long integers, in bands that double until the distance fits.

Texts that differ in d places cost some length * d / 64 word operations, whatever they hold; what both begin and end with
costs next to nothing. Hyyro (2003) gives the recurrence for a band of diagonals.
"""

from __future__ import annotations

import os

import pyarrow as pa

LEAST_BAND = 64


def distance(a: str, b: str) -> int:
    """How many characters to insert, delete or replace to make a into b."""
    k = len(os.path.commonprefix((a, b)))
    a, b = a[k:], b[k:]
    k = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for c in set(b):
        bits, at = bytearray(len(a) // 8 + 1), a.find(c)
        while at >= 0:
            bits[at >> 3] |= 1 << (at & 7)
            at = a.find(c, at + 1)
        places[c] = int.from_bytes(bits, "little")
    band = min(max(LEAST_BAND, len(a) - len(b)), len(a))
    while (d := _within(places, len(a), b, band)) > band and band < len(a):
        band = min(2 * band, len(a))
    return d


def _within(places: dict[str, int], m: int, b: str, k: int) -> int:
    """The distance from a text of m >= len(b) characters, m >= k, if it is at most k; else some number above k.

    places: a bit for each place of a character in that text. Column j holds the vertical steps of rows j - k to j + k.
    """
    size = 2 * k + 1
    full = (1 << size) - 1
    rises, falls = (full >> k) << k, 0
    bottom = k
    for j, c in enumerate(b, 1):
        shift = j - k - 1
        equal = (places[c] >> shift if shift > 0 else places[c] << -shift) & full
        diagonal = (((equal & rises) + rises) ^ rises | equal | falls) & full
        right_up, right_down = (falls | ~(diagonal | rises)) & full, diagonal & rises
        row = m - j + k
        if row >= size - 1:
            bottom += 1 - (diagonal >> size - 1 & 1)  # the band's lowest diagonal is not beyond the last row
        else:
            bottom += (right_up >> row & 1) - (right_down >> row & 1)
        below = diagonal >> 1
        rises, falls = (right_down | ~(below | right_up)) & full, below & right_up
    return bottom


def distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Row by row; null if either is."""
    return pa.array([None if x is None or y is None else distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())
