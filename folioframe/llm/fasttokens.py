"""Byte-level BPE of whole columns with the tokenizers library: each distinct piece of text goes through the library once.

The library splits a text into pieces (words with the space before them, numbers, runs of marks, white space) and
encodes each piece for itself, so a column needs only its distinct pieces encoded. The split is done here on arrays of
code points, for texts whose characters all lie in blocks where the classes of the split are settled (Latin, marks,
ASCII); any other text, and one that holds the string of an added token, goes through the library as it is. A piece is
looked up by a hash and compared in full: up to 16 code points as four numbers, longer ones as strings. So what comes out
is what the library's plain encode() gives.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import xxhash

SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
PARTS = 4  #: numbers of four code points each that tell pieces apart
#: What keeps so many of a number's code points, and the factors of a piece's hash.
MASKS = np.array([0, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFF, 0xFFFFFFFFFFFFFFFF], np.uint64)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25], np.uint64)
CHUNK = 1 << 18  #: code points that are split at once; some fifteen arrays of eight bytes each are held for them
JOINED = 1000  #: pieces that the library gets in one text
MOST_PIECES = 1_000_000  #: of the cache; it starts anew beyond that


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point below 0x2070; all others are unsure."""
    table = np.full(0x2071, UNSURE, np.uint8)
    for cp in [*range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]:
        kind = unicodedata.category(chr(cp))[0]
        table[cp] = {"L": LETTER, "N": NUMBER, "Z": SPACE}.get(kind, OTHER) if kind != "C" else UNSURE
    table[[9, 10, 13]] = SPACE
    return table


def parts_of(cps: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """The first code points of each piece, four to a number, with zeros beyond its end; a list of PARTS such numbers for each piece."""
    units = np.concatenate([cps.astype("<u2"), np.zeros(4 * PARTS, "<u2")])
    view = np.ndarray(shape=(len(units) - 3,), dtype="<u8", buffer=units, strides=(2,))
    size, out = e - s, []
    for j in range(PARTS):
        own = np.arange(len(s)) if j == 0 else np.flatnonzero(size > 4 * j)  # few pieces are long
        part = np.zeros(len(s), np.uint64)
        part[own] = view[s[own] + 4 * j] & MASKS[np.minimum(size[own] - 4 * j, 4)]
        out.append(part)
    return out


def piece_starts(cps: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where pieces start. first, last: flags of the first and last code point of each text."""
    n = len(cps)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before something else goes with it if it is a space, and else stands alone
    ends = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:]) if n > 1 else np.zeros(0, np.int64)
    start[ends] = True
    start[ends[cps[ends] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll where a piece starts with the mark
    q = np.flatnonzero((cps == 39) & start & ~last)
    if len(q):
        end = np.searchsorted(np.flatnonzero(last), q)
        left = np.flatnonzero(last)[end] - q  # code points after the mark in its text
        a, b = cps[np.minimum(q + 1, n - 1)], cps[np.minimum(q + 2, n - 1)]
        one = (left >= 1) & np.isin(a, [ord(c) for c in "stmd"])
        two = (left >= 2) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        size = np.where(two, 3, np.where(one, 2, 0))
        q, size, left = q[size > 0], size[size > 0], left[size > 0]
        start[q + 1] = False
        after = q[left >= size] + size[left >= size]
        start[after] = True
    return np.flatnonzero(start)


class Grown:
    """An array that grows at its end; all holds what is there."""

    def __init__(self, kind):
        self.held, self.size = np.zeros(1024, kind), 0

    def add(self, new: np.ndarray) -> None:
        end = self.size + len(new)
        if end > len(self.held):
            self.held = np.concatenate([self.held[: self.size], np.zeros(max(end, len(self.held) * 3 // 2) - self.size, self.held.dtype)])
        self.held[self.size : end] = new
        self.size = end

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.size]


class Encoder:
    """encode(texts) -> (ids of all texts one after another, ids of each)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are busy with other tasks
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        # one that takes nothing from what stands beside it; no piece holds its string
        self.mark = next(((t.content, n) for n, t in sorted(added.items()) if not (t.lstrip or t.rstrip or t.single_word)), None)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int32)  # of each key, in what follows
        self.place = Grown(np.int64)  # of the piece's ids
        self.count = Grown(np.int32)
        self.length = Grown(np.int64)  # code points of the piece
        self.parts = [Grown(np.uint64) for _ in range(PARTS)]
        self.ids = Grown(np.uint32)
        self.long: dict[int, str] = {}  # pieces longer than the parts, by key

    def learn(self, keys: np.ndarray, pieces: list[str], parts: list[np.ndarray]) -> None:
        """keys: sorted, and none known yet."""
        ids, count = self.encoded(pieces)
        slots, begin = self.place.size + np.arange(len(keys), dtype=np.int32), self.ids.size
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slots)
        self.place.add(begin + np.concatenate([[0], np.cumsum(count[:-1], dtype=np.int64)]))
        self.count.add(count)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.length.add(size)
        for held, new in zip(self.parts, parts):
            held.add(new)
        self.ids.add(ids)
        self.long |= {int(keys[i]): pieces[i] for i in np.flatnonzero(size > 4 * PARTS)}

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has. The library encodes what stands between added tokens by itself, so many pieces go in one text."""
        if self.mark is None:
            found = [x.ids for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int32, len(found))
        text, number = self.mark
        found = self.library.encode_batch_fast([text.join(pieces[i : i + JOINED]) + text for i in range(0, len(pieces), JOINED)], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        ends = np.flatnonzero(ids == number)
        return ids[ids != number], np.diff(ends, prepend=-1).astype(np.int32) - 1

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By the library alone."""
        found = [self.library.encode(x, add_special_tokens=False).ids for x in texts]
        return np.array([i for x in found for i in x], np.uint32), np.array(list(map(len, found)), np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        outs, counts = [], np.zeros(len(texts), np.int64)
        batch: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal batch, size
            if batch:
                ids, n = self.some([texts[i] for i in batch])
                outs.append(ids)
                counts[batch] = n
            batch, size = [], 0

        for i, x in enumerate(texts):
            if size + len(x) > CHUNK:
                flush()
            if len(x) > CHUNK:
                ids, n = self.plain([x])
                outs.append(ids)
                counts[i] = n[0]
            else:
                batch.append(i)
                size += len(x)
        flush()
        return np.concatenate(outs) if outs else np.zeros(0, np.uint32), counts

    def some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.uint32), lens
        cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = classes()[np.minimum(cps, 0x2070)]
        ends = np.cumsum(lens)
        unsure = np.add.reduceat(np.append(kind == UNSURE, False), np.minimum(ends - lens, len(cps))) > 0
        unsure &= lens > 0
        if any(a in whole for a in self.added):
            unsure |= np.array([any(a in x for a in self.added) for x in texts])
        if unsure.any():  # in runs, so that the order stays
            outs, counts, a = [], [], 0
            for i in [*np.flatnonzero(unsure), len(texts)]:
                if i > a:
                    ids, n = self.some(texts[a:i])
                    outs.append(ids)
                    counts.append(n)
                if i < len(texts):
                    ids, n = self.plain(texts[i : i + 1])
                    outs.append(ids)
                    counts.append(n)
                a = i + 1
            return np.concatenate(outs), np.concatenate(counts)
        first, last = np.zeros(len(cps), bool), np.zeros(len(cps), bool)
        some = lens > 0
        first[(ends - lens)[some]], last[ends[some] - 1] = True, True
        s = piece_starts(cps, kind, first, last)
        e = np.append(s[1:], len(cps))
        parts, size = parts_of(cps, s, e), e - s
        h = size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        with np.errstate(over="ignore"):  # a collision is noticed below
            for p, f in zip(parts, FACTORS):
                h += p * f
            h ^= h >> np.uint64(29)
        long = np.flatnonzero(size > 4 * PARTS)
        text_of = lambda i: whole[s[i] : e[i]]
        for i in long.tolist():
            h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(text_of(i).encode("utf-8", "surrogatepass")))
        keys, where, back = np.unique(h, return_index=True, return_inverse=True)
        # pieces under one key must be one piece; a key known already must be that piece's
        rep = where[back]
        same = np.array_equal(size, size[rep])
        for j, p in enumerate(parts):
            own = slice(None) if j < 2 else np.flatnonzero(size > 4 * j)  # the others are zero in all
            same = same and np.array_equal(p[own], p[rep[own]])
        same = same and all(text_of(i) == text_of(rep[i]) for i in long.tolist())
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            at = np.minimum(at, len(self.keys) - 1)
            known = self.keys[at] == keys
            old, new = self.slot[at[known]], where[known]
            same = same and (self.length.all[old] == size[new]).all() and all((p.all[old] == q[new]).all() for p, q in zip(self.parts, parts))
            large = size[new] > 4 * PARTS
            same = same and all(self.long[k] == text_of(i) for k, i in zip(keys[known][large].tolist(), new[large].tolist()))
        if not same:  # two pieces with one hash
            return self.plain(texts)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > MOST_PIECES:
                self.forget()
                known[:] = False
            new = np.flatnonzero(~known)
            self.learn(keys[new], [text_of(i) for i in where[new].tolist()], [p[where[new]] for p in parts])
            at = np.searchsorted(self.keys, keys)
        at = self.slot[at][back]
        count = self.count.all[at].astype(np.int64)
        upto = np.cumsum(count)
        ids = self.ids.all[np.repeat(self.place.all[at] - (upto - count), count) + np.arange(upto[-1])]
        totals = np.concatenate([[0], upto])
        cut = np.searchsorted(s, np.append(ends - lens, len(cps)))
        return ids, np.diff(totals[cut])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that its cache serves all of the worker's tasks."""
    return Encoder(path)
