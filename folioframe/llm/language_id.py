"""Language identification by rank-order profiles of character n-grams (Cavnar and Trenkle, 1994).

A text becomes its letters, lower-cased, in words with a blank on either side; n-grams of one to three of these characters
are counted. A profile is the `RANKS` most frequent n-grams in order. A text's distance to a language is the sum, over the
text's own most frequent n-grams, of how far each is out of its place in the language's profile, or RANKS where it is
not there. The closest language wins; ties go to the smaller name. The score is one less the mean distance over RANKS.

Training: n-grams of a bounded sample of labelled texts, at most about `train_rows` for each language, chosen by a hash of
the id; whole texts. Profiles (languages x RANKS rows) are collected and sent with the tasks.

Edge cases: a text that is null or has no letters gets "und" and score 0. With nothing to learn from every text gets "und".
Labels that are null are not learned from. Rows are independent of each other. Only the named columns are read; when
predicting, only the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import load, small_batches

RANKS = 300
TRAIN_ROWS = 4000
SLICE = 1 << 18  #: code points that are worked on at once
BITS = np.int64(21)


@lru_cache(1)
def letters() -> np.ndarray:
    """The lower-case letter for each code point, 0 for all that is none."""
    table = np.zeros(0x110000, np.int64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of all texts in order of the texts, each packed into 63 bits, and how many each text has."""
    lens = np.fromiter((len(x) + 2 for x in texts), np.int64, len(texts))
    whole = "".join(f"\n{x}\n" for x in texts)
    c = letters()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(texts)), lens)
    keep = np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0) | (doc[1:] != doc[:-1])])  # one blank in a row, but for the ends of texts
    c, doc = c[keep] + 1, doc[keep]  # 1 is a blank
    a = c[:-1] << BITS | c[1:]
    b = a[:-1] << BITS | c[2:]
    two, three = (c[:-1] > 1) | (c[1:] > 1), c[1:-1] > 1  # not blanks alone, and words' ends but not their gaps
    two &= doc[:-1] == doc[1:]
    three &= doc[:-2] == doc[2:]
    out, owner = np.concatenate([c[c > 1], a[two], b[three]]), np.concatenate([doc[c > 1], doc[:-1][two], doc[:-2][three]])
    counts = np.bincount(owner, minlength=len(texts))
    return out[np.argsort(owner, kind="stable")], counts


def most_frequent(x: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent values, most frequent first; ties by value."""
    value, n = np.unique(x, return_counts=True)
    if len(value) > ranks:
        least = np.partition(n, len(n) - ranks)[len(n) - ranks]
        few = n >= least
        value, n = value[few], n[few]
    return value[np.lexsort((value, -n))][:ranks]


def slices(texts: list[str]):
    a, size = 0, 0
    for i, x in enumerate(texts):
        if i > a and size + len(x) > SLICE:
            yield a, i
            a, size = i, 0
        size += len(x)
    if a < len(texts):
        yield a, len(texts)


def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, gram, n: summed over what a task reads."""
    held: dict[str, list] = {}
    for batch in rows:
        labels, texts = np.array(batch.column(0).to_pylist(), object), [x or "" for x in batch.column(1).to_pylist()]
        for label in set(labels.tolist()):
            own = [texts[i] for i in np.flatnonzero(labels == label)]
            for a, b in slices(own):
                value, n = np.unique(grams(own[a:b])[0], return_counts=True)
                if label in held:
                    v, back = np.unique(np.concatenate([held[label][0], value]), return_inverse=True)
                    held[label] = [v, np.bincount(back, np.concatenate([held[label][1], n])).astype(np.int64)]
                else:
                    held[label] = [value, n]
    for label, (value, n) in held.items():
        yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(value)), "gram": pa.array(value), "n": pa.array(n)})


def learn(labelled: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", train_rows: int = TRAIN_ROWS, ranks: int = RANKS) -> dict[str, list[int]]:
    """The profile of each label: at most `ranks` n-grams, most frequent first."""
    small_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.col(key).cast("string").alias("key"))
    known = [(r["label"], train_rows / r["count"]) for r in rows.groupBy("label").count().collect()]  # a row for each language
    if not known:
        return {}
    share = F.lit(0.0)
    for name, s in known:
        share = F.when(F.col("label") == name, F.lit(s)).otherwise(share)
    place = F.conv(F.substring(F.md5(F.coalesce("key", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    sample = rows.filter(place < share).select("label", "text")
    n = sample.mapInArrow(counted, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "gram"))
    top = n.withColumn("r", nth).filter(F.col("r") <= ranks).collect()  # languages x ranks
    out: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["label"], r["r"])):
        out.setdefault(r["label"], []).append(r["gram"])
    return out


def nearest(texts: list[str], profiles: list[tuple[str, np.ndarray, np.ndarray]], ranks: int) -> tuple[list[str], list[float]]:
    """profiles: label, its n-grams sorted, and the rank of each."""
    labels, scores = [], []
    for a, b in slices(texts):
        x, counts = grams(texts[a:b])
        ends = np.cumsum(counts)
        for upto, n in zip(ends.tolist(), counts.tolist()):
            if not n or not profiles:
                labels.append("und")
                scores.append(0.0)
                continue
            top = most_frequent(x[upto - n : upto], ranks)
            own, best = np.arange(len(top)), None
            for label, value, rank in profiles:
                at = np.minimum(np.searchsorted(value, top), len(value) - 1)
                d = int(np.where(value[at] == top, np.minimum(np.abs(rank[at] - own), ranks), ranks).sum())
                if best is None or d < best[0]:
                    best = (d, label)
            labels.append(best[1])
            scores.append(1.0 - best[0] / (len(top) * ranks))
    return labels, scores


def predicted(rows: Iterator[pa.RecordBatch], profiles: dict[str, list[int]], ranks: int, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    table = []
    for label, values in sorted(profiles.items()):
        order = np.argsort(values)
        table.append((label, np.array(values, np.int64)[order], np.arange(len(values))[order]))
    for batch in rows:
        labels, scores = nearest([x or "" for x in batch.column(0).to_pylist()], table, ranks)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], *names])


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: int = RANKS, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns `keep`, and those named by label and score, which must be none of them."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("_text"), *(docs[c] for c in keep))
    schema = StructType(rows.schema.fields[1:]).add(label, "string").add(score, "double")
    return rows.mapInArrow(partial(predicted, profiles=profiles, ranks=ranks, names=(label, score)), schema)


def remainder(key: Column, m: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % m


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    profiles = learn(docs.filter(~F.col("held_out")))
    return predict(docs, profiles, keep=("doc_id", "held_out"))
