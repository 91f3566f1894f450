"""Near-duplicates by Order MinHash over five-word shingles, verified by banded alignment.

Exact copies (equal words) are classes from the start, found by grouping on a fingerprint, and one of them, that with the
smallest id, stands for all. A representative is sketched: its shingles are labelled with how often they occurred before
in the text; each of `functions` hash functions picks the `PICKED` labelled shingles with the smallest values, and these
in text order make a key. Documents with equal keys under some function share shingles in the same order, which is what
edit similarity asks for. In texts of up to `SHORT` words each shingle is a key besides.

A candidate counts if the edit distance of the word sequences is at most (1 - similarity) times the longer one; alignment
runs in a band of that many diagonals. Verified pairs are links, and the classes are the links' connected components.
Candidates come from keys, in turns; no pair whose texts are in one class already is compared again:

1. Under each key of the first `EARLY` functions the smallest id is the hub, and all others are compared with it.
2. The same under the keys of all functions.
3. Keys whose members, but for the hub, are all in one class are done. Of the others, those of up to `FEW` members have all
   pairs left compared.
4. The texts of larger ones, as a passage common to unrelated texts makes them, meet again under their rarest pairs of
   neighbouring words. An edit undoes two pairs at most, so texts that are alike have a number of them in common, and one of
   the rarest, if each text shows all its pairs but that number less one. Of these keys those of up to `FEW` texts and more
   than one class have all pairs compared.
5. The texts of those that are larger still (two words that are most of each text) meet in tiles: all texts of a block with
   all of another, blocks being texts of about one length. A tile gives the pairs whose word counts, in `COUNTERS` counters,
   allow a link, and these are compared. So of texts that share any key no link is left out. Counts are compared in arrays;
   what grows with the square of a block is neither shuffled nor written.

Joins of what grows with the corpus are shuffle joins at every size: by a hash of the smaller side where that is ids or keys
alone, by merging where it is texts. For the rest Spark's own broadcast threshold decides.

Skew: hubs are minima taken before the shuffle; joins by a hot key or hub are split by AQE; the join by fingerprint
broadcasts the fewer than 1,000 fingerprints that more than a thousandth of the rows have. Nothing that grows with the data
is collected or broadcast.

Edge cases: a text with fewer than five words, but some, is one shingle. Null texts and texts without any character are
each in a class of their own; texts without words but with characters are copies if they are equal. Each row is classed by
its own text, also where ids repeat or are null; ids may be of any type that has an order. Null ids come last, so a class
has a null class_id only if all its ids are null. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_all, load, small_batches, tasks_for, written
from .components import components

SHINGLE, SIMILARITY, FUNCTIONS, PICKED = 5, 0.8, 64, 2
EARLY, FEW = 16, 8
#: From this similarity on texts that are alike have two neighbouring words in common, wherever the edits stand.
LEAST_FOR_PAIRS, BUCKET_BITS = 0.75, 18
#: Blocks of texts of one length: so many from `BLOCK` texts each on, then larger ones of up to so many texts and words.
BLOCKS, BLOCK, MOST_TEXTS, MOST_WORDS, COUNTERS = 8, 256, 4096, 1 << 22, 1024
#: Texts of up to so many words have each of their shingles as a key besides, as an edit or two may leave no two of them;
#: texts of up to `TINY` words, of which one edit may leave none, each of their runs of three.
SHORT, TINY = 30, 9
HOT_SHARE = 1000
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: np.ndarray, counts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, labelled by occurrence, and how many each text has."""
    from .wordarrays import mixed

    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), n)
    at = (ends - counts)[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        s = np.zeros(len(at), np.uint64)
        for j in range(k):
            inside = at + j < ends[doc]  # a short text has fewer words
            s = s * np.uint64(0x9FB21C651E98DF25) + np.where(inside, words[np.minimum(at + j, len(words) - 1)], np.uint64(j))
        s = mixed(s)
        # the nth occurrence of a shingle in its text gets the label n
        own = s ^ mixed(doc.astype(np.uint64), 3)
        order = np.argsort(own, kind="stable")
        run = np.concatenate([[True], own[order][1:] != own[order][:-1]]) if len(own) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(run, np.arange(len(own)), 0)) if len(own) else np.zeros(0, np.int64)
        nth = np.empty(len(own), np.uint64)
        nth[order] = np.arange(len(own)) - first
        return mixed(s + nth * np.uint64(0xA0761D6478BD642F)), n


def sketch_keys(hashes: np.ndarray, n: np.ndarray, functions: list[int], picked: int = PICKED) -> np.ndarray:
    """[text, key]: a key for each function; zero for texts without words. A text with fewer shingles has all of them in its key."""
    from .wordarrays import mixed

    some = np.flatnonzero(n > 0)
    out = np.zeros((len(n), len(functions)), np.uint64)
    if not len(some):
        return out
    size = n[some]
    begin = np.cumsum(size) - size
    at = np.arange(len(hashes))
    end = np.uint64(0x5851F42D4C957F2D)
    with np.errstate(over="ignore"):
        for column, f in enumerate(functions):
            g = mixed(hashes, f + 11)
            places = []
            for _ in range(min(picked, int(size.max()))):
                low = np.minimum.reduceat(g, begin)
                place = np.minimum.reduceat(np.where(g == np.repeat(low, size), at, len(at)), begin)
                places.append(np.where(low == TOP, len(at), place))
                g[place] = TOP
            places = np.sort(np.stack(places), axis=0)  # in text order
            key = np.full(len(some), np.uint64(f), np.uint64)
            for p in places:
                key = mixed(key * np.uint64(0xE7037ED1A0B428DB) + np.where(p < len(at), hashes[np.minimum(p, len(at) - 1)], end))
            out[some, column] = key
    return out


def printed(words: np.ndarray, text: bytes) -> bytes | None:
    """What copies have in common: the words; the characters if there are none; nothing if there are none either."""
    import hashlib

    what = words.tobytes() if len(words) else b"text:" + text if text else None
    return hashlib.blake2b(what, digest_size=16).digest() if what is not None else None


def short_keys(words: np.ndarray) -> np.ndarray:
    """A key for each run of a short text. Of five words with another in the middle only pairs stay, so they are keys too."""
    from .wordarrays import mixed

    one, n = np.array([len(words)]), len(words)
    return np.concatenate([mixed(shingles(words, one, k)[0], 7 + k) for k in ((3, 2) if n == 5 else (3,) if n <= TINY else (SHINGLE,))])


def byte_texts(column) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def lists_of(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values.view(np.int64)))


def sketched(rows: Iterator[pa.RecordBatch], functions: int) -> Iterator[pa.RecordBatch]:
    """rid (another one for each row), id, place, print, n (words), keys."""
    from pyspark import TaskContext

    from .wordarrays import batches, words_of

    nth = TaskContext.get().partitionId() << 33
    for big in rows:
        texts = byte_texts(big.column(2))
        for a, b in batches(texts, 1 << 19):
            words, counts = words_of(texts[a:b])
            sketch, prints, keys = sketch_keys(*shingles(words, counts), list(range(functions))), [], []
            for i, (upto, c) in enumerate(zip(np.cumsum(counts).tolist(), counts.tolist())):
                own = words[upto - c : upto]
                prints.append(printed(own, texts[a + i]))
                keys.append(np.concatenate([sketch[i], short_keys(own)]) if 0 < c <= SHORT else sketch[i])
            cols = [pa.array(nth + np.arange(b - a)), big.column(0).slice(a, b - a), big.column(1).slice(a, b - a), pa.array(prints, pa.binary()), pa.array(counts), lists_of(np.concatenate(keys), np.array([len(x) for x in keys]))]
            nth += b - a
            yield pa.RecordBatch.from_arrays(cols, ["rid", "id", "place", "print", "n", "keys"])


def as_words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """print, words: 32 bits of each word's hash."""
    from .wordarrays import batches, words_of

    for big in rows:
        texts = byte_texts(big.column(0))
        for a, b in batches(texts):
            words, counts = words_of(texts[a:b])
            each = [words[e - c : e] for e, c in zip(np.cumsum(counts), counts)]
            yield pa.RecordBatch.from_arrays([pa.array([printed(w, t) for w, t in zip(each, texts[a:b])], pa.binary()), pa.array([w.astype(np.uint32).tobytes() for w in each], pa.binary())], ["print", "words"])


def in_buckets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """b, n: how many of a batch's word pairs fall in each bucket of their hashes."""
    for batch in rows:
        at = [pair_hashes(x) >> np.uint64(64 - BUCKET_BITS) for x in batch.column("words").to_pylist()]
        b, n = np.unique(np.concatenate(at), return_counts=True) if at else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int64)), pa.array(n)], ["b", "n"])


def pair_hashes(words: bytes) -> np.ndarray:
    """A hash for each two neighbouring words, labelled by occurrence."""
    w = np.frombuffer(words, np.uint32).astype(np.uint64)
    return shingles(w, np.array([len(w)]), 2)[0]


def least_shared(n: int, similarity: float) -> int:
    """How many word pairs a text of n words has in common with any text alike of n words or more: an edit undoes two at most."""
    return max(1, min(x - 1 - 2 * int((1 - similarity) * x + 1e-9) for x in range(n, n + int(1 / (1 - similarity) + 1e-9) + 1)))


def rare_pairs(rows: Iterator[pa.RecordBatch], similarity: float, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """k, id, n, label: the rarest word pairs of each text, so many that texts which are alike have one of them in common."""
    for batch in rows:
        keys = []
        for n, x in zip(batch.column("n").to_pylist(), batch.column("words").to_pylist()):
            h = pair_hashes(x)
            order = np.lexsort((h, often[h >> np.uint64(64 - BUCKET_BITS)]))
            keys.append(h[order[: max(0, len(h) - least_shared(n, similarity) + 1)]])
        at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(keys) if keys else np.zeros(0, np.uint64)).view(np.int64)), *(batch.column(c).take(pa.array(at)) for c in ("id", "n", "label"))], ["k", "id", "n", "label"])


def word_counts(words: list[bytes]) -> np.ndarray:
    """[text, counter]: how many of a text's words fall in each of COUNTERS classes of their hashes."""
    from .wordarrays import mixed

    own = [np.frombuffer(x, np.uint32).astype(np.uint64) for x in words]
    return np.stack([np.bincount((mixed(w, 5) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS) for w in own]).astype(np.int32)


def met_in_tile(rows: pa.Table, similarity: float) -> pa.Table:
    """a < b of one tile: pairs of two blocks, or of one, whose lengths and word counts allow a link; labels differ."""
    ids, n, label, own = (rows.column(c).to_numpy() for c in ("id", "n", "label", "own"))
    counts = word_counts(rows.column("words").to_pylist())
    left, right = np.flatnonzero(own), np.flatnonzero(~own)
    one = not len(right)  # a block with itself
    a, b = [], []
    for nth, i in enumerate(left.tolist()):
        js = left[nth + 1 :] if one else right
        longer = np.maximum(n[i], n[js])
        most = np.floor((1 - similarity) * longer + 1e-9)
        fits = (np.abs(n[i] - n[js]) <= most) & (label[js] != label[i])
        js, longer, most = js[fits], longer[fits], most[fits]
        if len(js):
            js = js[longer - np.minimum(counts[i], counts[js]).sum(axis=1) <= most]
            a.append(np.minimum(ids[i], ids[js]))
            b.append(np.maximum(ids[i], ids[js]))
    none = np.zeros(0, np.int64)
    return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})


def aligned(rows: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    from .alignment import distance_within

    for batch in rows:
        keep = []
        for x, y in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist()):
            a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            keep.append(distance_within(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9)) is not None)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def met_hubs(members: DataFrame, hubs: DataFrame, similarity: float, which: Column | None = None) -> DataFrame:
    """a < b: members (k, id, n) with hubs (k, hub, m) of their key, where the lengths allow a link."""
    both = members.join(hubs, "k").filter(F.expr("id <> hub") if which is None else which).filter(F.abs(F.col("n") - F.col("m")) <= F.floor((1 - similarity) * F.greatest("n", "m") + 1e-9))
    return both.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))


def smallest(members: DataFrame, tasks: int) -> DataFrame:
    """k, hub, m: the member with the smallest id of each key; a table, so that AQE may split what is joined to it by a hot key."""
    return written(members.groupBy("k").agg(F.min(F.struct("id", "n")).alias("h")).select("k", F.col("h.id").alias("hub"), F.col("h.n").alias("m")), "near-hubs", tasks=tasks)


class Linker:
    """Classes found so far, as labels (v, label: its smallest id); texts: id, words."""

    def __init__(self, texts: DataFrame, similarity: float, tasks: int = 1):
        self.texts, self.similarity, self.labels, self.tasks = texts, similarity, None, tasks  # tasks: that write a table of members

    def labelled(self, rows: DataFrame, column: str, label: str) -> DataFrame:
        if self.labels is None:
            return rows.withColumn(label, F.col(column))
        named = self.labels.select(F.col("v").alias(column), F.col("label").alias(label))
        return rows.join(named, column, "left").withColumn(label, F.coalesce(label, column))

    def compare(self, met: DataFrame) -> None:
        """Align the pairs a, b, with repeats, that are not in one class, and join the classes of those that are alike."""
        pairs = met.distinct()
        if self.labels is not None:
            pairs = self.labelled(self.labelled(pairs, "a", "la"), "b", "lb").filter("la <> lb").select("a", "b")
        one = pairs.join(self.texts.select(F.col("id").alias("a"), F.col("words").alias("wa")).hint("merge"), "a")
        both = one.join(self.texts.select(F.col("id").alias("b"), F.col("words").alias("wb")).hint("merge"), "b").select("a", "b", "wa", "wb")
        new = written(both.mapInArrow(partial(aligned, similarity=self.similarity), "a long, b long"), "near-links")
        if self.labels is None:
            self.labels = components(new)
        elif new.limit(1).count():
            # between classes; the links within are settled
            between = self.labelled(self.labelled(new, "a", "la"), "b", "lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
            joined_ = components(written(between, "near-between", tasks=self.tasks), drop=True)
            moved = joined_.select(F.col("v").alias("label"), F.col("label").alias("to"))
            old = self.labels
            ids = old.unionByName(new.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(old, "v", "left_anti").select("v", F.col("v").alias("label")))
            self.labels = written(ids.join(moved, "label", "left").select("v", F.coalesce("to", "label").alias("label")), "near-labels", tasks=self.tasks)
            drop_all(old, joined_)
        drop_all(new)

    def open_keys(self, members: DataFrame, hubs: DataFrame) -> DataFrame:
        """k, size: keys that hold, behind their hub, texts of more than one class."""
        rest = members.join(hubs.select("k", F.col("hub").alias("id")), ["k", "id"], "left_anti")
        named = self.labelled(rest.select("k", "id"), "id", "label")
        return named.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low <> high").select("k", "size")


def link_all(members: DataFrame, texts: DataFrame, similarity: float) -> Linker:
    """members: k, f (function), id, n (words) under keys that more than one text has."""
    linker = Linker(texts, similarity, tasks_for(members.sparkSession, members.count(), 32))
    hubs = smallest(members, linker.tasks)
    linker.compare(met_hubs(members.filter(F.col("f") < EARLY), hubs, similarity))
    linker.compare(met_hubs(members, hubs, similarity))
    large = all_but_large(linker, members, hubs)
    if large is not None:
        hard = paired(large, linker) if similarity >= LEAST_FOR_PAIRS else large
        if hard is not None:
            until_settled(linker, hard)
        drop_all(large, *([] if hard is None or hard is large else [hard]))
    return linker


def all_but_large(linker: Linker, members: DataFrame, hubs: DataFrame) -> DataFrame | None:
    """Compare all pairs under the open keys of up to FEW members, and give the members of the larger ones, if any, as a table."""
    rows = written(members.join(linker.open_keys(members, hubs), "k"), "near-open", tasks=linker.tasks)
    drop_all(hubs)
    counts = rows.agg(F.count(F.when(F.col("size") < FEW, 1)), F.count(F.when(F.col("size") >= FEW, 1))).collect()[0]
    if counts[0]:
        small = rows.filter(F.col("size") < FEW)
        linker.compare(met_hubs(small, ranked(small, 1, FEW), linker.similarity))
    large = written(rows.filter(F.col("size") >= FEW), "near-large", tasks=linker.tasks) if counts[1] else None
    drop_all(rows)
    return large


def paired(large: DataFrame, linker: Linker) -> DataFrame | None:
    """Compare texts of large (id) that share one of their rarest word pairs with up to FEW; give the texts (id) that share one with more, if any, as a table.

    Pairs are rare by how many fall in a bucket of their hashes. Any order would do for completeness; this one leaves
    what many of the texts have in common (the passage that brought them under one key) out, unless it is most of a text.
    """
    parts = large.select("id").distinct().join(linker.texts.hint("shuffle_hash"), "id").select("id", F.expr("octet_length(words) div 4").cast("long").alias("n"), "words")
    parts = written(linker.labelled(parts, "id", "label"), "near-parts")
    sizes = parts.mapInArrow(in_buckets, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** BUCKET_BITS rows
    often = np.zeros(1 << BUCKET_BITS, np.int64)
    often[sizes.column("b").to_numpy()] = sizes.column("n").to_numpy()
    rows = written(parts.mapInArrow(partial(rare_pairs, similarity=linker.similarity, often=often), "k long, id long, n long, label long"), "near-pairs")
    keys = rows.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low <> high")
    keys = written(keys.select("k", "size"), "near-open", tasks=linker.tasks)
    small = written(rows.join(keys.filter(F.col("size") <= FEW).hint("shuffle_hash"), "k", "left_semi"), "near-small", tasks=linker.tasks)
    hard = written(rows.join(keys.filter(F.col("size") > FEW).hint("shuffle_hash"), "k", "left_semi").select("id").distinct(), "near-hard", tasks=linker.tasks)
    drop_all(parts, rows, keys)
    other = small.select("k", F.col("id").alias("hub"), F.col("n").alias("m"), F.col("label").alias("others"))
    linker.compare(met_hubs(small, other, linker.similarity, F.expr("id < hub and label <> others")))
    drop_all(small)
    if hard.limit(1).count():
        return hard
    drop_all(hard)
    return None


def blocks_of(counts: dict[int, int], similarity: float) -> dict[int, int]:
    """In how many blocks the texts of each class of lengths are dealt."""
    longest = {c: (1 / similarity) ** (c + 1) for c in counts}
    most = {c: int(max(16, min(MOST_TEXTS, MOST_WORDS // longest[c]))) for c in counts}
    return {c: max(-(-n // most[c]), min(BLOCKS, -(-n // BLOCK))) for c, n in counts.items()}


def until_settled(linker: Linker, members: DataFrame) -> None:
    """Compare all texts of members (id) whose lengths and word counts allow a link."""
    similarity = linker.similarity
    # texts that are alike are in one class of lengths or in two that follow each other
    n = F.expr("octet_length(words) div 4").cast("long")
    texts = members.select("id").distinct().join(linker.texts.hint("shuffle_hash"), "id").select("id", n.alias("n"), F.floor(F.log(n) / (np.log(1 / similarity) + 1e-6)).cast("int").alias("c"), "words")
    texts = written(linker.labelled(texts, "id", "label"), "near-tiled")
    counts = {r.c: r.n for r in texts.groupBy("c").agg(F.count("*").alias("n")).collect()}  # a few for each tenfold of lengths
    dealt = blocks_of(counts, similarity)
    blocks = [(c, p) for c in sorted(dealt) for p in range(dealt[c])]
    tiles = [(x, y) for c, p in blocks for d in (c, c + 1) for q in range(dealt.get(d, 0)) if (x := (c, p)) <= (y := (d, q))]
    at = [(*x, nth, True) for nth, (x, _) in enumerate(tiles)] + [(*y, nth, False) for nth, (x, y) in enumerate(tiles) if x != y]
    spark = members.sparkSession
    many = spark.createDataFrame([(c, k) for c, k in dealt.items()], "c int, parts int")
    placed = texts.join(F.broadcast(many), "c").withColumn("p", F.expr("pmod(xxhash64(id), parts)").cast("int"))
    rows = placed.join(F.broadcast(spark.createDataFrame(at, "c int, p int, tile int, own boolean")), ["c", "p"]).select("tile", "own", "id", "n", "label", "words")
    met = written(rows.groupBy("tile").applyInArrow(lambda t: met_in_tile(t, similarity), "a long, b long"), "near-met")
    drop_all(texts)
    linker.compare(met)
    drop_all(met)


def ranked(members: DataFrame, past: int, upto: int) -> DataFrame:
    """k, hub, m: members of each key in places past + 1 to upto by id."""
    nth = F.row_number().over(Window.partitionBy("k").orderBy("id"))
    first = members.select("k", "id", "n").withColumn("r", nth).filter(F.col("r") <= upto)
    return first.filter(F.col("r") > past).select("k", F.col("id").alias("hub"), F.col("n").alias("m"))


def classified(docs: DataFrame, text: str, key: str, similarity: float, functions: int) -> tuple[DataFrame, DataFrame | None]:
    """One row for each row of docs: rid, id, place, n_words, rep (id of the first of its exact copies), head (rid that stands for the class), class_id; and the hot places, if any."""
    small_batches(docs.sparkSession)
    kind = dict(docs.select(F.col(key).alias("id")).dtypes)["id"]
    own = docs.select(F.col(key).alias("id"), place(key, text).alias("place"), F.col(text).alias("text"))
    rows = written(own.mapInArrow(partial(sketched, functions=functions), f"rid long, id {kind}, place string, print binary, n long, keys array<long>"), "near-sketches")
    n_rows = rows.count()
    tasks, few = tasks_for(docs.sparkSession, n_rows, 100), tasks_for(docs.sparkSession, n_rows, 40)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("m")
    prints = rows.filter("print is not null").groupBy("print").agg(first, F.count("*").alias("copies"), F.max("n").alias("n"))
    prints = written(prints.select("print", F.col("m.id").alias("rep"), F.col("m.rid").alias("uid"), "copies", "n"), "near-prints", tasks=tasks)
    # rows that repeat an id and a text more often than a thousandth of all rows: fewer than a thousand places
    hot = written(rows.groupBy("place").agg(F.count("*").alias("size")).filter(F.col("size") * HOT_SHARE > F.lit(n_rows)).filter("size > 1").select("place"), "near-hot", tasks=1)
    hot = hot if hot.limit(1).count() else None
    # one row stands for its copies
    keyed = rows.join(prints.filter("n > 0").select(F.col("uid").alias("rid")).hint("shuffle_hash"), "rid", "left_semi").select(F.col("rid").alias("id"), "n", F.posexplode("keys").alias("f", "k")).withColumn("f", F.least("f", F.lit(functions)))
    shared = keyed.groupBy("k").agg(F.count("*").alias("size")).filter("size > 1").select("k")
    members = written(keyed.join(shared.hint("shuffle_hash"), "k", "left_semi").select("k", "f", "id", "n"), "near-members", tasks=tasks_for(docs.sparkSession, n_rows * functions, 32))
    wanted = written(prints.select("print", F.col("uid").alias("id")).join(members.select("id").distinct().hint("shuffle_hash"), "id", "left_semi"), "near-wanted", tasks=few)
    places = rows.select("rid", "place").join(wanted.select(F.col("id").alias("rid")).hint("shuffle_hash"), "rid", "left_semi").select("place").distinct()
    found = thinned(own, hot).join(places.hint("shuffle_hash"), "place", "left_semi").select("text").mapInArrow(as_words, "print binary, words binary")
    texts = written(found.join(wanted.hint("shuffle_hash"), "print").groupBy("id").agg(F.max("words").alias("words")), "near-words")
    linker = link_all(members, texts, similarity)
    labels = linker.labels
    drop_all(texts, wanted, members)
    # what each print's rows are named by
    classes = prints.select(F.col("uid").alias("v"), F.col("rep")).join(labels, "v")
    order = F.struct(F.col("rep").isNull(), "rep", "v")
    heads = classes.groupBy("label").agg(F.min_by(F.struct("rep", "v"), order).alias("h")).select("label", F.col("h.rep").alias("class_id"), F.col("h.v").alias("head"))
    known = classes.join(heads, "label").select(F.col("v").alias("uid"), "class_id", "head")
    named = prints.join(known, "uid", "left").filter("copies > 1 or head is not null")
    named = written(named.select("print", "copies", "rep", F.coalesce("head", "uid").alias("head"), F.when(F.col("head").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id")), "near-named", tasks=tasks)
    drop_all(labels, prints)
    out = joined(rows.drop("keys"), named, "print", "copies")
    alone = F.col("head").isNull()
    out = out.select("rid", "id", "place", F.col("n").alias("n_words"), F.when(alone, F.col("id")).otherwise(F.col("rep")).alias("rep"), F.coalesce("head", "rid").alias("head"), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
    out = written(out, "near-classes", tasks=tasks)
    drop_all(rows, named)
    return out, hot


def thinned(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows, of each hot place only one; others may repeat."""
    if hot is None:
        return rows
    return rows.join(F.broadcast(hot), "place", "left_anti").unionByName(rows.join(F.broadcast(hot), "place", "left_semi").dropDuplicates(["place"]))


def joined(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """rows left-joined with table, which has one row for each key and in `size` how many rows hold it; at most HOT_SHARE keys are hot and broadcast."""
    values = [c for c in table.columns if c not in (key, size)]
    total = table.agg(F.coalesce(F.sum(size), F.lit(0))).collect()[0][0]
    is_hot = F.col(size) * HOT_SHARE > total  # so they are fewer than HOT_SHARE
    hot = F.broadcast(table.filter(is_hot).select(F.col(key), F.struct(*values).alias("_hot")))
    cold = table.filter(~is_hot).select(F.col(key).alias("_key"), F.struct(*values).alias("_cold"))
    both = rows.join(hot, key, "left")
    # a row that is settled goes to a place of its own, where nothing meets it
    both = both.withColumn("_at", F.when(F.col("_hot").isNull(), F.col(key))).withColumn("_salt", F.when(F.col("_at").isNull(), F.xxhash64("rid")).otherwise(0))
    both = both.join(cold.withColumn("_none", F.lit(0).cast("long")), (F.col("_at") == F.col("_key")) & (F.col("_salt") == F.col("_none")), "left")
    found = F.coalesce("_hot", "_cold")
    return both.select(*rows.columns, *(found[c].alias(c) for c in values))


def place(key: str, text: str) -> Column:
    """One value for an id, which may be null, and a text: it finds a row again."""
    mark = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("none")), F.lit(" "), mark).cast("binary"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, functions: int = FUNCTIONS) -> DataFrame:
    """One row for each row of docs: id, n_words, rep (smallest id of its exact copies), class_id (smallest id of its class)."""
    return classified(docs, text, key, similarity, functions)[0].select("id", "n_words", "rep", "class_id")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, functions: int = FUNCTIONS) -> DataFrame:
    """docs, all columns, with one row of each class: of those with the smallest id. Rows without any text all stay."""
    some = F.length(F.coalesce(F.col(text), F.lit(""))) > 0
    found, hot = classified(docs, text, key, similarity, functions)
    heads = found.filter("rid = head").select("place").distinct()
    own = thinned(docs.filter(some).select(place(key, text).alias("place"), F.struct(*(docs[c] for c in docs.columns)).alias("row")), hot)
    kept = own.join(heads.hint("shuffle_hash"), "place", "left_semi")
    # rows that repeat both id and text
    first = F.row_number().over(Window.partitionBy("place").orderBy(F.lit(1)))
    return kept.withColumn("first", first).filter("first = 1").select("row.*").union(docs.filter(~some))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", F.col("rep").alias("copy_of"), "class_id")
