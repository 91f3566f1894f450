"""Token-ID output: a content-addressed store of id chunks, recipes in document order, and Merkle manifests.

Layout of a store folder (all Parquet):

* chunks/kind=c: key (16-byte BLAKE2b of the ids), data (ids, little-endian, 2 or 4 bytes each), n, width. Each once.
* recipes/kind=d: one row per document in ascending id order: part, rank and start within the part, doc_id, n_tokens, chunks
  (keys in order), root (SHA-256 over id, length and keys).
* recipes/kind=p: one row per part: documents, ids and the Merkle root over its documents' roots in order.
* manifest: format, tokens of the vocabulary, documents, ids, Merkle root over the parts.

Writing: each text is encoded once. Ids are cut where a rolling hash over 16 ids meets a mask (at least 64, on average
some 500, at most 4,096 ids), so an inserted word changes a chunk or two. A task emits the bytes of a chunk the first
time it meets it; one shuffle by key brings equal chunks together, at most one from each task, and the first is stored.
So a hot chunk costs one row a task. Recipes ride on the same shuffle, each under a key of its own.

Reading back: every chunk's bytes are read, their hash compared with the key and a CRC-32 taken; only the CRC travels to
the recipes (a join by key, which AQE splits where one is hot), where CRCs are joined in order. Recipes prove their roots,
parts theirs. Any difference raises an error. `restore` gives the ids themselves.

Edge cases: a null or empty text is the end id alone. Rows that repeat an id are documents of their own, next to each other,
in the order of their roots; null ids come first. An empty table makes an empty store. Only the named columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, shuffle_partitions, small_batches, work_path

LEAST, MASK, MOST, SPAN = 64, 511, 4096, 16
SLICE = 500  #: documents that are encoded together
ROLL = np.uint64(0xD6E8FEB86659FD93)
ROLL_INVERSE = np.uint64(pow(int(ROLL), -1, 1 << 64))
STAGED = "kind string, key binary, doc_id {id}, n long, width int, chunks array<binary>, root binary, data binary"
RECIPES = "kind string, part int, rank long, start long, doc_id {id}, n_tokens long, chunks array<binary>, root binary, n_docs long"


@lru_cache(2)
def roll_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (ROLL, ROLL_INVERSE))


def rolling(ids: np.ndarray) -> np.ndarray:
    """The hash of the SPAN ids up to each place (of all before it, near the start)."""
    size = max(1 << 16, 1 << int(len(ids)).bit_length())
    up, down = roll_powers(size)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * up[: len(ids)])])
        at = np.arange(len(ids))
        low = np.maximum(at - SPAN + 1, 0)
        h = (sums[at + 1] - sums[low]) * down[at]
        h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h >> np.uint64(40)


def cuts(marks: list[int], n: int) -> list[int]:
    """Ends of the chunks of n ids; marks: the places where the rolling hash allows an end."""
    ends, at = [], 0
    while n - at > LEAST:
        i = bisect.bisect_left(marks, at + LEAST)
        end = marks[i] if i < len(marks) else n
        end = min(end, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; a level's odd last node goes up as it is."""
    nodes = leaves or [b""]
    while len(nodes) > 1:
        nodes = [hashlib.sha256(b"".join(nodes[i : i + 2])).digest() if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


class Tree:
    """The same root from leaves one at a time, in memory that grows with the depth."""

    def __init__(self):
        self.levels: list[bytes | None] = []
        self.any = False

    def add(self, node: bytes) -> None:
        self.any = True
        for k, held in enumerate(self.levels):
            if held is None:
                self.levels[k] = node
                return
            node, self.levels[k] = hashlib.sha256(held + node).digest(), None
        self.levels.append(node)

    def root(self) -> bytes:
        node = None
        for held in self.levels:
            if held is not None:
                node = held if node is None else hashlib.sha256(held + node).digest()
        return node if node is not None else b""


def doc_root(doc_id, n: int, keys: list[bytes]) -> bytes:
    return hashlib.sha256(f"{doc_id}:{n}:".encode() + b"".join(keys)).digest()


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    from .fasttokens import encoder

    own, seen, nth = encoder(path), set(), 0
    kind = np.dtype("<u2" if width == 2 else "<u4")
    for big in batches:
        for batch in (big.slice(i, SLICE) for i in range(0, len(big), SLICE)):
            doc_ids, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            ids, counts = own.encode(texts)
            counts = counts + 1
            totals = np.cumsum(counts)
            whole = np.insert(ids, totals[:-1] - np.arange(1, len(totals)), end_id) if len(totals) > 1 else ids
            whole = np.append(whole, np.uint32(end_id)) if len(totals) else whole
            # no cut lies within the first LEAST ids, so the hash never looks beyond a document's start
            marks = np.flatnonzero((rolling(whole) & np.uint64(MASK)) == 0) + 1
            edges = np.searchsorted(marks, np.concatenate([[0], totals]))
            rows: list[tuple] = []
            raw = whole.astype(kind).tobytes()
            for i, (doc_id, n, upto) in enumerate(zip(doc_ids.to_pylist(), counts.tolist(), totals.tolist())):
                keys = []
                first, a = upto - n, 0
                for b in cuts((marks[edges[i] : edges[i + 1] + 1] - first).tolist(), n) if n > LEAST else [n]:
                    piece = raw[(first + a) * width : (first + b) * width]
                    key = hashlib.blake2b(piece, digest_size=16).digest()
                    keys.append(key)
                    if key not in seen:
                        if len(seen) >= 1_000_000:  # equal chunks meet again after the shuffle in any case
                            seen.clear()
                        seen.add(key)
                        rows.append(("c", key, None, b - a, width, None, None, piece))
                    a = b
                nth += 1
                root = doc_root(doc_id, n, keys)
                rows.append(("d", hashlib.blake2b(root + nth.to_bytes(8, "little"), digest_size=16).digest(), doc_id, n, width, keys, root, None))
            cols = list(zip(*rows))
            types = [pa.string(), pa.binary(), doc_ids.type, pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
            names = ["kind", "key", "doc_id", "n", "width", "chunks", "root", "data"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)


def numbered(batches: Iterator[pa.RecordBatch], id_type: str) -> Iterator[pa.RecordBatch]:
    """Rank and start of each recipe within its partition, and the partition's own row at the end."""
    from pyspark import TaskContext

    part, tree, rank, start, kind = TaskContext.get().partitionId(), Tree(), 0, 0, None
    for batch in batches:
        kind = batch.column("doc_id").type
        n = batch.column("n").to_numpy().astype(np.int64)
        upto = start + np.cumsum(n)
        for root in batch.column("root").to_pylist():
            tree.add(root)
        k = len(batch)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(["d"] * k), "part": pa.array([part] * k, pa.int32()), "rank": pa.array(np.arange(rank, rank + k)), "start": pa.array(upto - n), "doc_id": batch.column("doc_id"), "n_tokens": pa.array(n), "chunks": batch.column("chunks"), "root": batch.column("root"), "n_docs": pa.nulls(k, pa.int64())})
        rank, start = rank + k, start + int(n.sum())
    if rank:
        yield pa.RecordBatch.from_pydict({"kind": pa.array(["p"]), "part": pa.array([part], pa.int32()), "rank": pa.nulls(1, pa.int64()), "start": pa.nulls(1, pa.int64()), "doc_id": pa.nulls(1, kind), "n_tokens": pa.array([start], pa.int64()), "chunks": pa.nulls(1, pa.list_(pa.binary())), "root": pa.array([tree.root()], pa.binary()), "n_docs": pa.array([rank], pa.int64())})


def write_store(docs: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 0, vocabulary: int = 50_257) -> None:
    """Encode docs and write a store to path, a folder that all executors share. tokenizer: its JSON file, there on every machine."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = dict(docs.dtypes)[key]
    width = 2 if vocabulary <= 1 << 16 else 4
    staged = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(encoded, path=tokenizer, end_id=end_id, width=width), STAGED.format(id=id_type))
    parts = shuffle_partitions(spark)
    # equal keys come to one partition; sorted there, a chunk is kept if its key is not the one before it
    placed = staged.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(first_of_each, STAGED.format(id=id_type))
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{path}/chunks")
    recipes = store_table(spark, path, "chunks", STAGED.format(id=id_type)).filter("kind = 'd'").select("doc_id", "n", "chunks", "root")
    order = ["doc_id", "root", "nth"]
    ranged = recipes.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(partial(numbered, id_type=id_type), RECIPES.format(id=id_type)).write.mode("overwrite").option("compression", "zstd").partitionBy("kind").parquet(f"{path}/recipes")
    roots = [(r["part"], r["n_docs"], r["n_tokens"], bytes(r["root"])) for r in part_rows(spark, path, id_type)]
    manifest = [(1, tokenizer.rsplit("/", 1)[-1], end_id, id_type, sum(r[1] for r in roots), sum(r[2] for r in roots), bytearray(merkle([r[3] for r in roots])))]
    spark.createDataFrame(manifest, "format int, tokenizer string, end_id int, id_type string, n_docs long, n_tokens long, root binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None
    for batch in batches:
        keys, keep = batch.column("key").to_pylist(), []
        for k in keys:
            keep.append(k != before)
            before = k
        yield batch if all(keep) else batch.filter(pa.array(keep))


def store_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def part_rows(spark: SparkSession, path: str, id_type: str) -> list:
    """One row per part: as many as the partitions that wrote them."""
    return sorted(store_table(spark, path, "recipes", RECIPES.format(id=id_type)).filter("kind = 'p'").select("part", "n_docs", "n_tokens", "root").collect(), key=lambda r: r["part"])


def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = []
        for key, data, n, width in zip(*(batch.column(c).to_pylist() for c in ("key", "data", "n", "width"))):
            if hashlib.blake2b(data, digest_size=16).digest() != key or len(data) != n * width:
                raise ValueError(f"chunk {key.hex()} is damaged")
            crc.append(zlib.crc32(data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "cn": batch.column("n"), "crc": pa.array(crc, pa.int64())})


@lru_cache(1)
def zero_steps() -> np.ndarray:
    """[n, b]: what bit b of a CRC becomes after n ids of 4 bytes each, before their own CRC is added; n up to MOST."""
    out = np.zeros((MOST + 1, 32), np.uint32)
    out[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for n in range(1, MOST + 1):
        x = out[n - 1].copy()
        for _ in range(32):
            x = (x >> np.uint32(1)) ^ np.where(x & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        out[n] = x
    return out


def joined_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("facts").to_pylist()
        wanted = batch.column("n_tokens").to_pylist()
        n_chunks = batch.column("n_chunks").to_pylist()
        crc = np.zeros(len(lists), np.uint32)
        for doc_id, facts, n, k in zip(batch.column("doc_id").to_pylist(), lists, wanted, n_chunks):
            if len(facts) != k or sum(f["cn"] for f in facts) != n:
                raise ValueError(f"document {doc_id}: chunks are missing")
        steps, bits = zero_steps(), np.arange(32, dtype=np.uint32)
        for at in range(max(map(len, lists), default=0)):
            rows = np.array([i for i, f in enumerate(lists) if len(f) > at])
            n, own = (np.array([lists[i][at][c] for i in rows]) for c in ("cn", "crc"))
            moved = np.bitwise_xor.reduce(np.where((crc[rows, None] >> bits) & np.uint32(1), steps[n], np.uint32(0)), axis=1)
            crc[rows] = moved ^ own.astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"), "ids_crc32": pa.array(crc.astype(np.int64)), "root": batch.column("root")})


def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes, after a check of each root."""
    for batch in batches:
        for doc_id, n, keys, root in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "chunks", "root"))):
            if doc_root(doc_id, n, keys) != root:
                raise ValueError(f"the recipe of document {doc_id} is damaged")
        yield batch


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (over the whole store), n_tokens, chunks, root, part, rank; parts and manifest are checked against each other."""
    manifest = spark.read.parquet(f"{path}/manifest").collect()[0]
    id_type = manifest["id_type"]
    parts = part_rows(spark, path, id_type)
    if merkle([bytes(r["root"]) for r in parts]) != bytes(manifest["root"]) or sum(r["n_tokens"] for r in parts) != manifest["n_tokens"]:
        raise ValueError("the manifest does not agree with its parts")
    offsets, at = [], 0
    for r in parts:
        offsets.append((r["part"], at))
        at += r["n_tokens"]
    small = F.broadcast(spark.createDataFrame(offsets, "part int, offset long"))
    schema = RECIPES.format(id=id_type)
    rows = store_table(spark, path, "recipes", schema).filter("kind = 'd'").select("part", "rank", "start", "doc_id", "n_tokens", "chunks", "root")
    rows = rows.mapInArrow(proven, rows.schema)
    return rows.join(small, "part").withColumn("start", F.col("start") + F.col("offset")).drop("offset")


def verify_parts(spark: SparkSession, path: str) -> None:
    """Recompute each part's Merkle root from its documents, in order, and compare."""
    id_type = spark.read.parquet(f"{path}/manifest").collect()[0]["id_type"]
    rows = store_table(spark, path, "recipes", RECIPES.format(id=id_type)).filter("kind = 'd'").select("part", "rank", "root")

    def roots(batches):
        tree, part, n = Tree(), None, 0
        for batch in batches:
            for p, root in zip(batch.column("part").to_pylist(), batch.column("root").to_pylist()):
                if p != part and part is not None:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([n]), "root": pa.array([tree.root()], pa.binary())})
                    tree, n = Tree(), 0
                part, n = p, n + 1
                tree.add(root)
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([n]), "root": pa.array([tree.root()], pa.binary())})

    found = {r["part"]: (r["n"], bytes(r["root"])) for r in rows.repartitionByRange(shuffle_partitions(spark), "part").sortWithinPartitions("part", "rank").mapInArrow(roots, "part int, n long, root binary").collect()}
    if found != {r["part"]: (r["n_docs"], bytes(r["root"])) for r in part_rows(spark, path, id_type)}:
        raise ValueError("a part's documents do not give its root")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from a store's files; raises an error where they do not agree."""
    verify_parts(spark, path)
    recipes = read_recipes(spark, path)
    id_type = dict(recipes.dtypes)["doc_id"]
    chunks = store_table(spark, path, "chunks", STAGED.format(id=id_type)).filter("kind = 'c'").select("key", "data", "n", "width")
    facts = chunks.mapInArrow(checked, "key binary, cn long, crc long")
    # the document's own columns ride along once, not with each chunk: they come from its first row
    used = recipes.select("part", "rank", F.posexplode("chunks").alias("pos", "key"), F.struct("doc_id", "start", "n_tokens", "root", F.size("chunks").cast("long").alias("n_chunks")).alias("doc"))
    used = used.withColumn("doc", F.when(F.col("pos") == 0, F.col("doc")))
    both = used.join(facts.hint("merge"), "key")
    docs = both.groupBy("part", "rank").agg(F.max("doc").alias("doc"), F.array_sort(F.collect_list(F.struct("pos", "cn", "crc"))).alias("facts"))
    out = docs.select("doc.doc_id", "doc.start", "doc.n_tokens", "doc.root", "doc.n_chunks", "facts")
    return out.mapInArrow(joined_crcs, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, root binary")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array of long): every document's ids, put together from its chunks."""
    recipes = read_recipes(spark, path)
    chunks = store_table(spark, path, "chunks", STAGED.format(id=dict(recipes.dtypes)["doc_id"])).filter("kind = 'c'").select("key", "data", "width")
    both = recipes.select("doc_id", "start", F.posexplode("chunks").alias("pos", "key")).join(chunks.hint("merge"), "key")

    @F.pandas_udf("array<long>")
    def unpack(data, width):
        import pandas as pd

        return pd.Series([np.frombuffer(d, "<u2" if w == 2 else "<u4").astype(np.int64) for d, w in zip(data, width)])

    rows = both.withColumn("ids", unpack("data", "width")).groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("x"))
    return rows.select("doc_id", "start", F.flatten("x.ids").alias("ids"))


def token_digests(docs: DataFrame, name: str = "token-store", tokenizer: str | None = None, **options) -> DataFrame:
    import public_tokenizers

    path = work_path(docs.sparkSession, name)
    write_store(docs, path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), **options)
    return read_digests(docs.sparkSession, path)


def op2_token_store(spark, sf_dir: str) -> DataFrame:
    return token_digests(load(spark, sf_dir, "documents")).drop("root")
