"""Edit distance of two sequences within a band of diagonals, by bit-parallel columns on Python's long integers.

The band is as wide as the distances asked for; a column is one word of 2k + 2 bits, whatever k. Myers (1999) and Hyyro
(2003) give the recurrences.
"""

from __future__ import annotations

import numpy as np

#: Elements that stand at more places than this keep them as one long integer.
OFTEN = 64


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without what both begin with and both end with."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    k = n if same.all() else int(np.argmin(same))
    a, b = a[k:], b[k:]
    n = min(len(a), len(b))
    if n:
        same = a[-n:][::-1] == b[-n:][::-1]
        k = n if same.all() else int(np.argmin(same))
        a, b = a[: len(a) - k], b[: len(b) - k]
    return a, b


def bag_bound(a: np.ndarray, b: np.ndarray) -> int:
    """No more than the distance: what one has that the other lacks."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return max(len(a), len(b)) - int(np.minimum(nx[i], ny[j]).sum())


def distance_within(a: np.ndarray, b: np.ndarray, k: int) -> int | None:
    """The edit distance (insert, delete, replace one) of a and b if it is at most k, else None."""
    if abs(len(a) - len(b)) > k:
        return None
    a, b = trimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a) if len(a) <= k else None
    if bag_bound(a, b) > k:
        return None
    return banded(a.tolist(), b.tolist(), min(k, len(a)))


def banded(a: list, b: list, k: int) -> int | None:
    """len(a) >= len(b) > 0, len(a) - len(b) <= k. Rows are a, columns b; column j holds rows j - k .. j + k, lowest bit first."""
    m, n = len(a), len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    rows = {x: sum(1 << i for i in p) for x, p in places.items() if len(p) > OFTEN}
    size = 2 * k + 1
    ones = (1 << size) - 1
    # bit t of column j: row j + t - k + 1 (1-based rows of a; column j is 1-based as well)
    # before the first column D[i][0] = i: all vertical steps below row 0 are +1; rows above 0 do not exist and count as level
    up = (ones >> k) << k
    down = 0
    dist = k  # D at the lowest row of the band: row k before the first column
    for j in range(1, n + 1):
        shift = j - k - 1
        if b[j - 1] in rows:
            p = rows[b[j - 1]]
            eq = (p >> shift if shift >= 0 else p << -shift) & ones
        else:
            eq = 0
            for i in places.get(b[j - 1], ()):
                if 0 <= i - shift < size:
                    eq |= 1 << i - shift
        d0 = ((((eq & up) + up) ^ up) | eq | down) & ones
        hp = (down | ~(d0 | up)) & ones
        hn = d0 & up
        if j + k <= m:
            dist += not d0 >> size - 1 & 1  # down the band's lowest diagonal
        else:
            bit = m - j + k  # along row m
            dist += (hp >> bit & 1) - (hn >> bit & 1)
        d1 = d0 >> 1
        up = (hn | ~(d1 | hp)) & ones
        down = d1 & hp
    return dist if dist <= k else None
