"""Words of whole batches of texts as 64-bit hashes, by array operations on their UTF-8 bytes.

Words are maximal runs of ASCII digits and letters (A-Z lower-cased) and of anything beyond ASCII: the bytes of a character
beyond ASCII are all 0x80 or more, so bytes tell words as well as code points do.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
#: Words of up to so many bytes are hashed from their bytes as two numbers, longer ones by XXH3.
PACKED = 16

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True
IN_TOKEN = np.ones(256, bool)
IN_TOKEN[[0x20, 9, 10, 11, 12, 13]] = False

def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def batches(texts: list[bytes], most: int = CHUNK):
    """Runs of texts of up to `most` bytes in all, or of one longer text: (first, end)."""
    a, size = 0, 0
    for i, x in enumerate(texts):
        if i > a and size + len(x) > most:
            yield a, i
            a, size = i, 0
        size += len(x) + 1
    if a < len(texts):
        yield a, len(texts)


def eights(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place, as one number; zeros beyond `size`. data has eight bytes more than the last place."""
    view = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    kept = np.clip(size, 0, 8).astype(np.uint64) * np.uint64(8)
    full = kept >= np.uint64(64)
    mask = np.where(full, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.where(full, np.uint64(0), kept)) - np.uint64(1))
    return view[at] & mask


def hashed(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each s, e. Different words of one length of up to eight bytes differ in it; no rule gives others that agree."""
    import xxhash

    size = e - s
    padded = np.concatenate([data, np.zeros(2 * PACKED, np.uint8)])
    low, high = eights(padded, s, size), eights(padded, np.where(size > 8, s + 8, len(data)), size - 8)
    with np.errstate(over="ignore"):
        h = mixed(mixed(low) ^ (mixed(high, 5) * np.uint64(0xD6E8FEB86659FD93) * (size > 8)) ^ (size.astype(np.uint64) << np.uint64(56)))
    long = np.flatnonzero(size > PACKED)
    if len(long):
        raw = data.tobytes()
        h[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(s[long].tolist(), e[long].tolist())]
    return h


def words_of(texts: list[bytes], inside: np.ndarray = IN_WORD, spans: bool = False):
    """(hashes of all words in order, words of each text), and with spans also the joined bytes and each word's first and end byte in them. Best for up to CHUNK bytes at once."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = inside[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word])))  # joined by and ended with a separator
    s, e = edge[::2], edge[1::2]
    h = hashed(LOWERED[data], s, e)
    ends = np.cumsum([len(x) + 1 for x in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(s, ends)]))
    return (h, counts, data, s, e) if spans else (h, counts)
