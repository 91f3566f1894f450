"""Line deduplication over hash ranges, giving sparse per-document drop bitmaps instead of text. DataFrame functions only.

A line's key is the line stripped of ASCII white space and with A-Z lower-cased; it travels as two 64-bit hashes. Each
(key, salt), the salt made from the document, has a place in the hash space; the space is cut into equal ranges, one per
partition, and a partition is sorted by key, document and position. So a pass over it meets a key's lines in order and
takes its first occurrence and its number of documents, one row for each key and salt; the salts are then summed. A key
in a third of all documents is spread over `salts` places of the range, so no task gets it whole.

Keys in at least `min_docs` documents meet the lines again: broadcast if they are at most `broadcast_rows`, else by a
sort-merge join that AQE splits where a key is hot. What comes back is a drop bitmap per document, 64 lines a word, words
without a dropped line left out; documents that keep all have none. The bitmap meets the text once, by document.

keep="none" drops every line with such a key; keep="first" keeps the first by document and position.

Edge cases: a null or empty text is one empty line. Keys shorter than `min_chars` code points are never dropped. Rows that
repeat a key column and text are one document for the counts, and are treated alike; a null id is an id. Ties of the
first occurrence go to the smaller id, null first. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, load, shuffle_partitions, written

BLANKS = " \t\n\x0b\f\r"
SALTS = 64
BROADCAST_ROWS = 250_000


def lines_of(docs: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """id, t (hash of the text), pos, h1, h2 of each line whose key is long enough."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(whole).alias("t"), F.posexplode(F.split(whole, "\n")).alias("pos", "line"))
    rows = rows.withColumn("k", F.btrim("line", F.lit(BLANKS))).filter(F.char_length("k") >= min_chars).withColumn("k", ascii_lower(F.col("k")))
    return rows.select("id", "t", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), F.col("k")).alias("h2"))


def key_counts(lines: DataFrame, salts: int = SALTS) -> DataFrame:
    """h1, h2, n_docs, first (struct of id, t, pos)."""
    parts = shuffle_partitions(lines.sparkSession)
    rows = lines.withColumn("salt", F.pmod(F.xxhash64("id", "t"), F.lit(salts)))
    place = F.xxhash64("h1", "h2", "salt") / F.lit(2.0**64) + 0.5
    rows = rows.withColumn("part", F.least(F.floor(place * parts), F.lit(parts - 1)).cast("int")).repartitionById(parts, "part")
    order = Window.partitionBy("part", "h1", "h2", "salt").orderBy("id", "t", "pos")
    before = F.lag(F.struct("id", "t")).over(order)
    rows = rows.withColumn("fresh", F.when(before.eqNullSafe(F.struct("id", "t")), 0).otherwise(1))
    per = rows.groupBy("part", "h1", "h2", "salt").agg(F.sum("fresh").alias("n"), F.min(F.struct("id", "t", "pos")).alias("first"))
    return per.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first"))


def drop_bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 10, min_chars: int = 1, keep: str = "none", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, t, bits (array of (word, bits), sorted: bit pos % 64 of word pos div 64 is set if the line goes), n_dropped; only documents that lose a line."""
    lines = lines_of(docs, text, key, min_chars)
    common = written(key_counts(lines).filter(F.col("n_docs") >= min_docs), "line-keys")  # counted, then joined
    few = common.limit(broadcast_rows + 1).count() <= broadcast_rows  # a row is some 60 bytes
    hit = lines.join(F.broadcast(common) if few else common.hint("merge"), ["h1", "h2"])
    if keep == "first":
        hit = hit.filter(~F.struct("id", "t", "pos").eqNullSafe(F.col("first")))
    words = hit.groupBy("id", "t", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("id", "t").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bits"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with _kept (what is left of the text), _n_lines and _n_dropped."""
    whole = F.coalesce(docs[text], F.lit(""))
    gone = bitmaps.select(F.col("id").alias("_id"), F.col("t").alias("_t"), F.col("bits").alias("_bits"), F.col("n_dropped").alias("_n"))
    both = docs.join(gone.hint("shuffle_hash"), docs[key].eqNullSafe(F.col("_id")) & (F.xxhash64(whole) == F.col("_t")), "left")
    # dense words, so that a line's bit is found at once: zeros fill the gap before each word that is there
    dense = "flatten(transform(_bits, (x, i) -> concat(array_repeat(0L, x.word - if(i = 0, 0, _bits[i - 1].word + 1)), array(x.bits))))"
    both = both.withColumn("_dense", F.expr(f"if(_bits is null, null, {dense})")).withColumn("_lines", F.when(F.col("_bits").isNotNull(), F.split(docs[text], "\n")))
    left = "array_join(filter(_lines, (x, i) -> coalesce(shiftright(get(_dense, i div 64), i % 64) & 1, 0) = 0), '\n')"
    kept: Column = F.when(F.col("_bits").isNull(), whole).otherwise(F.expr(left))
    n = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    return both.select(*(docs[c] for c in docs.columns), kept.alias("_kept"), n.cast("long").alias("_n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("_n_dropped"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, drop_bitmaps(docs))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, {blanks}), '{UPPER}', '{LOWER}') as k from l),
f as (select k from k where length(k) >= 1 group by k having count(distinct doc_id) >= 10),
j as (select k.*, f.k is not null as gone from k left join f on k.k = f.k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from j group by doc_id"""
