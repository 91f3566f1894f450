"""Language-model scores of whole documents: an add-one unigram base and a gated recurrent model (see gated_lm).

Counts come from all training documents: a task counts the words of all it reads, and the counts are summed by the words'
64-bit hashes. The `HEAD` most frequent words at most (the bound is a number, not a share: the least power of two is taken
that no more words reach) go to every task, 16 bytes each. So most tokens find their count where they are read; a
document's other words, each once, are joined to the counts by hash, in a join that AQE splits where a word is hot.

The recurrent model knows the most frequent words and one stand-in for all others; a word behind the stand-in gets its
add-one share among these others, so the model is a proper distribution over the same words as the base. It learns from
all training documents, whole ones: every task goes on from the same start by truncated backpropagation over the documents
that it reads, and the tasks' parameters are averaged, weighted by their tokens, in a tree of `FAN` models a task, so that
no more than FAN of them (some 0.3 MB each) reach the driver. The start is fitted on the driver to a bounded sample: about
`train_docs` training documents, chosen by a hash, of up to `most_tokens` tokens each.

Edge cases: a null or empty text is the end token alone. Rows are scored for themselves, also where ids repeat; a null id
counts as training. Without training documents every count is 0 and the model is its initial one. An empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_all, load, small_batches, written
from .language_id import remainder

HEAD = 1_000_000
TRAIN_DOCS = 600
MOST_TOKENS = 20_000
FAN = 32
END_HASH = np.uint64(0x5EED0E4D5EED0E4D)
SLICE = 1 << 20


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, an end after each text, and the tokens of each."""
    from .wordarrays import IN_TOKEN, words_of

    h, counts = words_of(texts, IN_TOKEN)
    ends = np.cumsum(counts)
    return np.insert(h, ends, END_HASH), counts + 1


def byte_texts(column) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def merged(a, b):
    """Two sorted tables of hashes and counts, added."""
    if a is None:
        return b
    h, back = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return h, np.bincount(back, np.concatenate([a[1], b[1]])).astype(np.int64)


def counted(rows: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    from .wordarrays import batches

    held, fresh, waiting = None, [], 0
    pack = lambda t: pa.RecordBatch.from_arrays([pa.array(t[0].view(np.int64)), pa.array(t[1])], ["h", "n"])

    def settle():
        nonlocal held, fresh, waiting
        if fresh:
            words = np.concatenate(fresh)
            held = merged(held, np.unique(words, return_counts=True))
        fresh, waiting = [], 0

    for batch in rows:
        texts = byte_texts(batch.column(0))
        for a, b in batches(texts, SLICE):
            h, _ = tokens(texts[a:b])
            fresh.append(h)
            waiting += len(h)
            if waiting > 2_000_000:
                settle()
            if held is not None and len(held[0]) > most:  # the sum by hash comes later in any case
                yield pack(held)
                held = None
    settle()
    if held is not None:
        yield pack(held)


def word_counts(training: DataFrame, text: str = "text") -> DataFrame:
    """h, n: how often each word (by hash), and the end, occurs."""
    rows = training.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(counted, "h long, n long")
    return rows.groupBy("h").agg(F.sum("n").alias("n"))


def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A table h, n of bounded size on the driver, sorted by h."""
    t = df.toArrow()
    h, n = t.column("h").to_numpy().astype(np.int64).view(np.uint64), t.column("n").to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def looked_up(h: np.ndarray, keys: np.ndarray, values: np.ndarray, missing: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(h), missing, np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], missing)


def numbered(rows: Iterator[pa.RecordBatch], keys: np.ndarray, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """order, words: each document's word numbers, as bytes."""
    from .gated_lm import OTHER
    from .wordarrays import batches

    for batch in rows:
        texts = byte_texts(batch.column(1))
        for a, b in batches(texts, SLICE):
            h, counts = tokens(texts[a:b])
            w, ends = looked_up(h, keys, numbers, OTHER).astype("<i2"), np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([w[e - c : e].tobytes() for e, c in zip(ends, counts)], pa.binary())], ["order", "words"])


def trained(rows: Iterator[pa.RecordBatch], keys: np.ndarray, numbers: np.ndarray, start: dict) -> Iterator[pa.RecordBatch]:
    """words, model: what a task's documents make of the start."""
    from .gated_lm import OTHER, Learner, packed
    from .wordarrays import batches

    learner = Learner(start)
    for batch in rows:
        texts = byte_texts(batch.column(0))
        for a, b in batches(texts, SLICE):
            learner.learn(looked_up(tokens(texts[a:b])[0], keys, numbers, OTHER))
    learner.learn(np.zeros(0, np.int64), last=True)
    if learner.words:
        yield pa.RecordBatch.from_arrays([pa.array([learner.words]), pa.array([packed(learner.p)], pa.binary())], ["words", "model"])


def averaged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One model: the mean of a task's, weighted by words."""
    total, whole = 0, None
    for batch in rows:
        for n, x in zip(batch.column("words").to_pylist(), batch.column("model").to_pylist()):
            part = np.frombuffer(x, "<f4").astype(np.float64) * n
            total, whole = total + n, part if whole is None else whole + part
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(whole / total).astype("<f4").tobytes()], pa.binary())], ["words", "model"])


def learned(training: DataFrame, text: str, vocabulary: tuple[np.ndarray, np.ndarray], start: dict) -> dict:
    """The start, after all training documents."""
    from .gated_lm import unpacked

    rows = training.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    models = written(rows.mapInArrow(partial(trained, keys=vocabulary[0], numbers=vocabulary[1], start=start), "words long, model binary"), "lm-models")
    while (n := models.count()) > FAN:
        fewer = written(models.coalesce(-(-n // FAN)).mapInArrow(averaged, "words long, model binary"), "lm-models")
        drop_all(models)
        models = fewer
    last = list(averaged([pa.RecordBatch.from_arrays([c.combine_chunks() for c in models.orderBy("words").toArrow().columns], ["words", "model"])])) if n else []
    drop_all(models)
    return unpacked(last[0].column("model")[0].as_py(), start) if last else start


def scored(rows: Iterator[pa.RecordBatch], head: tuple[np.ndarray, np.ndarray], vocabulary: tuple[np.ndarray, np.ndarray], model: dict, slice_bytes: int = 4 * SLICE) -> Iterator[pa.RecordBatch]:
    """rid, the kept columns, n_tokens, n_known, base, lm (natural logs so far), and words whose count isn't in the head: rest (hash, times)."""
    from pyspark import TaskContext

    from .gated_lm import OTHER, scores
    from .wordarrays import batches

    nth = TaskContext.get().partitionId() << 33
    for batch in rows:
        texts = byte_texts(batch.column(0))
        for a, b in batches(texts, slice_bytes):
            parts = [tokens(texts[a:b][i:j]) for i, j in batches(texts[a:b], SLICE)]
            h, counts = np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])
            doc = np.repeat(np.arange(b - a), counts)
            c = looked_up(h, *head, -1)
            w = looked_up(h, *vocabulary, OTHER)
            found = c >= 0
            logs = np.log(np.maximum(c, 0) + 1.0)
            base = np.bincount(doc[found], logs[found], b - a)
            inside = found & (w == OTHER)  # of the stand-in's words, those whose count is known already
            lm = scores(model, w, counts) + np.bincount(doc[inside], logs[inside], b - a)
            others = np.bincount(doc[w == OTHER], minlength=b - a)
            known = np.bincount(doc[found & (c > 0)], minlength=b - a)
            pair = np.stack([doc[~found].astype(np.uint64), h[~found]], 1)
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            pair = pair[order]
            new = np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)]) if len(pair) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(pair)))
            ends = np.searchsorted(pair[first, 0], np.arange(b - a + 1, dtype=np.uint64))
            rest = pa.StructArray.from_arrays([pa.array(pair[first, 1].view(np.int64) if len(first) else np.zeros(0, np.int64)), pa.array(times.astype(np.int64))], ["h", "times"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)
            cols = [pa.array(nth + np.arange(b - a)), *(x.slice(a, b - a) for x in batch.columns[1:]), pa.array(counts), pa.array(known), pa.array(others), pa.array(base), pa.array(lm), lists]
            nth += b - a
            yield pa.RecordBatch.from_arrays(cols, ["rid", *batch.schema.names[1:], "n_tokens", "n_known", "n_others", "base", "lm", "rest"])


def lm_scores(docs: DataFrame, training, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), head: int = HEAD, train_docs: int = TRAIN_DOCS, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """key, keep, n_tokens, n_known, train_tokens, base_score, score (log10) for every row; training: the condition that marks what to learn from."""
    from .gated_lm import END, OTHER, WORDS, train

    small_batches(docs.sparkSession)
    learn = docs.filter(training)
    counts = written(word_counts(learn, text), "lm-counts")
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()  # at most 64 rows
    n_all, v_all = sum(r["tokens"] for r in steps), sum(r["words"] for r in steps)
    least, upto = 62, 0
    for r in sorted(steps, key=lambda r: -r["p"]):
        if upto + r["words"] > head:
            break
        least, upto = r["p"], upto + r["words"]
    frequent = arrays(counts.filter(F.col("n") >= F.lit(1 << least)))
    # the model's vocabulary: the end, the stand-in, and the most frequent words, ties by hash
    top = arrays(counts.filter(F.col("h") != int(END_HASH.view(np.int64))).orderBy(F.desc("n"), "h").limit(WORDS - 2))
    order = np.lexsort((top[0], -top[1]))
    names = np.concatenate([[END_HASH], top[0][order]])
    numbers = np.concatenate([[END], np.arange(2, 2 + len(order))])
    place = np.argsort(names)
    vocabulary = (names[place], numbers[place].astype(np.int64))
    n_end = int(looked_up(np.array([END_HASH]), *frequent, 0)[0]) or int((counts.filter(F.col("h") == int(END_HASH.view(np.int64))).agg(F.sum("n")).collect()[0][0]) or 0)
    # so that no word of the vocabulary is looked for elsewhere
    keys, first = np.unique(np.concatenate([frequent[0], top[0], np.array([END_HASH] * (n_end > 0), np.uint64)]), return_index=True)
    frequent = (keys, np.concatenate([frequent[1], top[1], np.array([n_end] * (n_end > 0), np.int64)])[first])
    # what is left behind the stand-in, with one place for words never seen
    z_others = (n_all - int(top[1].sum()) - n_end) + (v_all - len(top[1]) - (n_end > 0)) + 1
    share = min(1.0, train_docs / n_end) if n_end else 0.0
    seen = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    sample = learn.filter(seen < share).select(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("order"), F.col(text).alias("text"))
    fit = sample.mapInArrow(partial(numbered, keys=vocabulary[0], numbers=vocabulary[1]), "order string, words binary").filter(F.octet_length("words") <= 2 * most_tokens)
    texts = [np.frombuffer(r["words"], "<i2").astype(np.int64) for r in sorted(fit.collect(), key=lambda r: (r["order"], bytes(r["words"])))]
    model = learned(learn, text, vocabulary, train(texts, 2 + len(order)))
    rows = docs.select(F.col(text).alias("_text"), key, *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    done = rows.mapInArrow(partial(scored, head=frequent, vocabulary=vocabulary, model=model), f"rid long, {kept}, n_tokens long, n_known long, n_others long, base double, lm double, rest array<struct<h:bigint,times:bigint>>")
    done = written(done, "lm-scored")
    tail = counts.filter(F.col("n") < F.lit(1 << least))
    pairs = done.select("rid", F.inline("rest"))
    got = pairs.join(tail.hint("merge"), "h", "left").select("rid", "times", F.coalesce("n", F.lit(0)).alias("n"))
    logs = F.col("times") * F.ln(F.col("n") + 1.0)
    more = got.groupBy("rid").agg(F.sum(logs).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    both = done.drop("rest").join(more.hint("merge"), "rid", "left")
    ten, extra = float(np.log(10)), F.coalesce("more", F.lit(0.0))
    out = both.select(
        key, *keep, "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        ((F.col("base") + extra - F.col("n_tokens") * float(np.log(n_all + v_all + 1))) / ten).alias("base_score"),
        ((F.col("lm") + extra - F.col("n_others") * float(np.log(z_others))) / ten).alias("score"),
    )
    out = written(out, "lm-result")
    drop_all(counts, done)
    return out


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False)))
    return lm_scores(docs, ~F.col("held_out"), keep=("held_out",))
