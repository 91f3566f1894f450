"""Exact top-k by inner product: document-range blocks, visited by each query in falling order of their bounds.

Vectors become integers, floor(scale * x). They are put in order by nearest pivot (a bounded sample of the rows) and id, and
cut into ranges of up to `BLOCK_ROWS` rows, so a pivot near which a third of all rows lies gives many blocks, not a large
one. A block row holds its forward index (all its vectors), and per component the largest and smallest value: a query's
bound for a block is the sum over components of the larger of the two products, which no vector in it exceeds.

A query first meets the block in which it stands itself, which tends to hold its neighbours; its k-th score there is its
threshold. Bounds are taken of chunks of queries against parts of the table of block summaries, in a join; blocks whose
bound reaches the threshold are the query's list, in falling order of bounds. The list is visited in waves (the first 4,
then up to 16, 64 ... blocks): at each wave a block is scored against those queries that have it in the wave and whose
threshold, carried on from the waves before, its bound still reaches. A query ends when the next bound is below its k-th
score. Ties at the threshold stay. A query keeps its k best, so a wave adds at most k rows for each query and block.

Scores are sums of products of integers, taken in float64 where all stay below 2^53 and in Python's integers beyond.

Edge cases: vectors that are null, empty, or hold a null or non-finite component take no part; nor do, for a query, those
of another length. Scaled components beyond 2^53 in size count as 2^53, and scores beyond 64 bits as the largest or
smallest long. Rows with the query's own id are no candidates; rows that repeat a query's id and vector are one query,
other repeated rows are candidates each, and equal ones rank next to each other. An id with several vectors is a query for
each. Fewer candidates than k give as many results. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_all, load, shuffle_partitions, written

K, SCALE, EVERY = 20, 64, 20
PIVOTS, BLOCK_ROWS, CHUNK, SUMMARIES = 32, 512, 256, 1024
FIRST_WAVE, WIDER = 4, 4
LARGEST = 2**53
LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame, vector: str, key: str, scale: float) -> DataFrame:
    """id, dim, v (array of long): the vectors that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")).filter(F.col("x").isNotNull() & F.col("id").isNotNull())
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = rows.filter((F.size("x") > 0) & sound)
    whole = lambda c: F.floor(F.least(F.greatest(c.cast("double") * float(scale), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("long")
    return rows.select("id", F.size("x").alias("dim"), F.transform("x", whole).alias("v"))


def dealt(rows: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """dim, pivot, id, v: the nearest pivot of each vector."""
    for batch in rows:
        dims, lists = batch.column("dim").to_numpy(), batch.column("v")
        near = np.zeros(len(batch), np.int32)
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            x = matrix(lists.take(pa.array(own)), d).astype(np.float64)
            p = pivots[int(d)].astype(np.float64)
            near[own] = np.argmin((p * p).sum(1)[None, :] - 2 * x @ p.T, axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array(near), batch.column("id"), lists], ["dim", "pivot", "id", "v"])


def matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def raw(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def longs(x: bytes, dim: int | None = None) -> np.ndarray:
    a = np.frombuffer(x, "<i8")
    return a if dim is None else a.reshape(-1, dim)


def blocked(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """block, dim, ids, data, high, low: runs of rows with one length and pivot, as they come."""
    from pyspark import TaskContext

    part, nth, held, size, now = TaskContext.get().partitionId(), 0, [], 0, None

    def packed() -> pa.RecordBatch:
        nonlocal nth, held, size
        ids, v = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
        block, nth, held, size = part << 32 | nth, nth + 1, [], 0
        return pa.RecordBatch.from_pydict({"block": pa.array([block]), "dim": pa.array([v.shape[1]], pa.int32()), "ids": [raw(ids)], "data": [raw(v)], "high": [raw(v.max(0))], "low": [raw(v.min(0))]})

    for batch in rows:
        dims, pivots, ids, lists = (batch.column(c) for c in ("dim", "pivot", "id", "v"))
        dims, pivots, ids = dims.to_numpy(), pivots.to_numpy(), ids.to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(pivots) != 0)) + 1).tolist(), len(batch)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and now != (dims[a], pivots[a]):
                yield packed()
            now = (dims[a], pivots[a])
            v = matrix(lists.slice(a, b - a), int(dims[a]))
            while a < b:
                k = min(b - a, most - size)
                held.append((ids[a : a + k], v[:k]))
                a, v, size = a + k, v[k:], size + k
                if size == most:
                    yield packed()
    if held:
        yield packed()


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, as long integers or, where those would not do, Python's."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = max(abs(int(a.max())), abs(int(a.min())), 1) * max(abs(int(b.max())), abs(int(b.min())), 1) * a.shape[1]
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def clipped(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == np.int64 else np.clip(x, LEAST_LONG, MOST_LONG).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return clipped(exact(a, b))


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """[query, block]: no vector of the block scores more. High and low have a row for each block."""
    return clipped(exact(np.maximum(q, 0), high) + exact(np.minimum(q, 0), low))


def best_of(ids: np.ndarray, data: np.ndarray, qids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best in a block, of those that reach its floor."""
    for qid, floor, s in zip(qids, floors, products(q, data)):
        good = np.flatnonzero((ids != qid) & (s >= floor))
        if len(good) > k:
            good = good[s[good] >= np.partition(s[good], len(good) - k)[len(good) - k]]
        good = good[np.lexsort((ids[good], np.invert(s[good])))[:k]]
        yield ids[good], s[good]


def at_home(rows: Iterator[pa.RecordBatch], k: int, every: int) -> Iterator[pa.RecordBatch]:
    """Queries of each block with their k best in it: qkey, qid, dim, home, q, ids, scores."""
    for batch in rows:
        for row in batch.to_pylist():
            ids, data = longs(row["ids"]), longs(row["data"], row["dim"])
            at = np.flatnonzero(ids % every == 0)
            if not len(at):
                continue
            found = list(best_of(ids, data, ids[at], data[at], np.full(len(at), LEAST_LONG), k))
            q = [raw(data[i]) for i in at]
            yield pa.RecordBatch.from_pydict({
                "qkey": pa.array([hashlib.blake2b(raw(ids[i]) + x, digest_size=16).digest() for i, x in zip(at, q)], pa.binary()), "qid": pa.array(ids[at]), "dim": pa.array([row["dim"]] * len(at), pa.int32()),
                "home": pa.array([row["block"]] * len(at)), "q": pa.array(q, pa.binary()), "ids": pa.array([x.tolist() for x, _ in found], pa.list_(pa.int64())), "scores": pa.array([x.tolist() for _, x in found], pa.list_(pa.int64())),
            })


def chunked(rows: Iterator[pa.RecordBatch], keys: tuple[str, ...], lists: tuple[str, ...], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys, up to `most`, as one row: the keys, and lists of the other columns."""
    held, now, types = [], None, None

    def packed() -> pa.RecordBatch:
        cols = [pa.array([v], types[c]) for c, v in zip(keys, now)] + [pa.array([[r[c] for r in held]], pa.list_(types[c])) for c in lists]
        return pa.RecordBatch.from_arrays(cols, [*keys, *lists])

    for batch in rows:
        types = {c: batch.schema.field(c).type for c in (*keys, *lists)}
        for row in batch.to_pylist():
            own = tuple(row[c] for c in keys)
            if held and (own != now or len(held) == most):
                yield packed()
                held = []
            now = own
            held.append(row)
    if held:
        yield packed()


def summarised(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """part, dim, names, high, low: the summaries of up to `most` blocks of one length."""
    from pyspark import TaskContext

    nth = TaskContext.get().partitionId() << 32
    for batch in rows:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            for a in range(0, len(own), most):
                some = batch.take(pa.array(own[a : a + most]))
                yield pa.RecordBatch.from_pydict({"part": pa.array([nth]), "dim": pa.array([d], pa.int32()), "names": pa.array([some.column("block").to_pylist()], pa.list_(pa.int64())), "high": [b"".join(some.column("high").to_pylist())], "low": [b"".join(some.column("low").to_pylist())]})
                nth += 1


def listed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """qn, block, bound: the blocks of a part that a chunk's queries may gain from."""
    for batch in rows:
        for row in batch.to_pylist():
            names = np.array(row["names"], np.int64)
            q = longs(b"".join(row["q"]), row["dim"])
            bound = bounds(q, longs(row["high"], row["dim"]), longs(row["low"], row["dim"]))
            i, j = np.nonzero((bound >= np.array(row["kth"])[:, None]) & (names[None, :] != row["home"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(row["qn"], np.int64)[i]), pa.array(names[j]), pa.array(bound[i, j])], ["qn", "block", "bound"])


def scored(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """qn, vec_id, score: at most k for each query and block."""
    for batch in rows:
        for row in batch.to_pylist():
            ids, data = longs(row["ids"]), longs(row["data"], row["dim"])
            q, qn, out = longs(b"".join(row["q"]), row["dim"]), row["qn"], [[], [], []]
            for n, (names, s) in zip(qn, best_of(ids, data, np.array(row["qid"]), q, np.array(row["kth"]), k)):
                for column, x in zip(out, (np.full(len(names), n), names, s)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["qn", "vec_id", "score"])


def top_k(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = K, scale: float = SCALE, every: int = EVERY, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, summaries: int = SUMMARIES) -> DataFrame:
    """query_id, rank, vec_id, score. Queries are the rows whose key is divisible by `every`."""
    rows = quantised(vectors, vector, key, scale)
    parts = shuffle_partitions(vectors.sparkSession)
    # pivots: for each length those whose ids have the smallest hashes
    nth = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id"))
    picked: dict[int, list] = {}
    for r in rows.withColumn("_n", nth).filter(F.col("_n") <= pivots).select("dim", "v").collect():
        picked.setdefault(r["dim"], []).append(r["v"])
    centres = {d: np.array(x, np.int64) for d, x in picked.items()}
    near = rows.mapInArrow(partial(dealt, pivots=centres), "dim int, pivot int, id long, v array<long>")
    ranged = near.repartitionByRange(parts, "dim", "pivot", "id").sortWithinPartitions("dim", "pivot", "id")
    blocks = written(ranged.mapInArrow(partial(blocked, most=block_rows), "block long, dim int, ids binary, data binary, high binary, low binary"), "topk-blocks")
    home = blocks.mapInArrow(partial(at_home, k=k, every=every), "qkey binary, qid long, dim int, home long, q binary, ids array<long>, scores array<long>")
    # rows that repeat a query may stand in two blocks
    queries = written(home.dropDuplicates(["qkey"]).withColumn("qn", F.monotonically_increasing_id()).drop("qkey"), "topk-queries")
    best = written(queries.select("qn", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("qn", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score")), "topk-best")

    def kth(found: DataFrame) -> DataFrame:
        """qn, kth: the least score that can still matter."""
        least = found.groupBy("qn").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k)
        return queries.select("qn").join(least.select("qn", F.col("s").alias("kth")), "qn", "left").fillna({"kth": LEAST_LONG})

    sums = written(blocks.select("block", "dim", "high", "low").mapInArrow(partial(summarised, most=summaries), "part long, dim int, names array<long>, high binary, low binary"), "topk-summaries")
    asked = queries.select("qn", "dim", "home", "q").join(kth(best), "qn").repartitionByRange(parts, "dim", "home").sortWithinPartitions("dim", "home")
    chunks = asked.mapInArrow(partial(chunked, keys=("dim", "home"), lists=("qn", "q", "kth"), most=CHUNK), "dim int, home long, qn array<long>, q array<binary>, kth array<long>")
    # a row for each part of up to `summaries` blocks: some 2 million times fewer than vectors
    whole = F.broadcast(sums.groupBy("dim").agg(F.collect_list("part").alias("parts")))
    met = chunks.join(whole, "dim").withColumn("part", F.explode("parts")).drop("parts").join(sums.hint("merge"), ["dim", "part"])
    some = met.mapInArrow(listed, "qn long, block long, bound long")
    lists = written(some.withColumn("place", F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("bound"), "block"))), "topk-lists")
    done, upto = 0, FIRST_WAVE
    while True:
        now = kth(best)
        left = lists.filter(F.col("place") > done).join(now, "qn").filter("bound >= kth")
        if not left.limit(1).count():
            break
        wave = left.filter(F.col("place") <= upto).select("qn", "block", "kth").join(queries.select("qn", "qid", "q"), "qn")
        wave = wave.repartition(parts, "block", F.pmod(F.xxhash64("qn"), F.lit(8))).sortWithinPartitions("block")
        packs = wave.mapInArrow(partial(chunked, keys=("block",), lists=("qn", "qid", "q", "kth"), most=CHUNK), "block long, qn array<long>, qid array<long>, q array<binary>, kth array<long>")
        found = packs.join(blocks.select("block", "dim", "ids", "data").hint("merge"), "block").mapInArrow(partial(scored, k=k), "qn long, vec_id long, score long")
        order = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id"))
        new = written(best.union(found).withColumn("r", order).filter(F.col("r") <= k).drop("r"), "topk-best")
        drop_all(best)
        best, done, upto = new, upto, upto * WIDER
    order = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id"))
    ranked = best.withColumn("rank", order).join(queries.select("qn", F.col("qid").alias("query_id")), "qn")
    out = written(ranked.select("query_id", "rank", "vec_id", "score"), "topk-result")
    drop_all(blocks, queries, best, sums, lists)
    return out


def op8_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"))


def oracle() -> str:
    return f"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(x::double * {SCALE}) as bigint)) as e from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on q.vec_id % {EVERY} = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= {K}"""
