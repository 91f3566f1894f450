"""Mixing sources to target weights by capped water-filling, and seeded repetitions of documents. DataFrame functions only.

A source's target is its share, by weight, of the total, but at most `max_epochs` times its size; what is cut off goes to
the others by weight until none is above. The fixed point has a closed form: with the sources ordered by cap / weight, the
first k are at their cap and the others get level * weight, level = (total - caps of those k) / (weights of the others),
k the least for which that respects all caps (the level falls from there on, so it is the largest such). It is one pass over one row per source.

A source with target t and size s takes every document floor(t / s) times, and a share of them once more: documents stand
in the order of a seeded hash, and those before the place where their sizes fill the rest are taken; the document across
that place is taken in part, so that the words taken are the rounded target. Places are found in two steps, so that no
task sorts a source: sizes are summed per source and hash bucket (4,096 of them), which finds the bucket that holds the
place; only that bucket's documents, a 4,096th of the source, are ordered. The hash is MD5, the same on any engine.

What was read of the text (id, source, size, hash) is written to the shared folder once, so the text is read once.

Edge cases: null text has size 0. A null source is a source of its own and comes last. A source of size 0 has target 0.
Rows that repeat an id and a text have equal hashes and share what is taken in an unspecified order among equals, so the
set of results is the same in each run. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MAX_EPOCHS = 2
BUCKET_DIGITS = 3
BROADCAST_ROWS = 100_000


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "0") -> DataFrame:
    """id, source, size, order (hex)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    return docs.select(F.col(key).alias("id"), F.col(source).alias("source"), size.alias("size"), order.alias("order"))


def targets(measured: DataFrame, weights=WEIGHTS, total: float = TOTAL, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: one row per source."""
    s = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth % len(weights) + 1)).withColumn("cap", F.col("source_size") * max_epochs)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    caps, used = F.coalesce(F.sum("cap").over(filled), F.lit(0)), F.coalesce(F.sum("weight").over(filled), F.lit(0))
    # the level if exactly the sources before this one are at their cap; this one is the first below iff the level suits it
    s = s.withColumn("level", (F.sum("source_size").over(every) * total - caps) / (F.sum("weight").over(every) - used))
    s = s.withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "0", **options) -> DataFrame:
    """id, source, size, order, source_size, target, taken."""
    measured = written(sizes(docs, text, key, source, seed), "mix-sizes")
    t = targets(measured, **options).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    t = written(t.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")), "mix-targets")  # read in several places
    bucket = F.substring("order", 1, BUCKET_DIGITS)
    sums = measured.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
    few = t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = lambda df: F.broadcast(df) if few else df.hint("merge")
    t = t.withColumnRenamed("source", "s")
    edge = sums.join(small(t), sums["source"].eqNullSafe(t["s"])).filter("before <= rest and rest < before + n").select(F.col("source").alias("es"), "bucket", "before")
    t = t.join(edge, t["s"].eqNullSafe(edge["es"]), "left").drop("es")
    rows = measured.join(small(t), measured["source"].eqNullSafe(t["s"])).drop("s")
    cols = ["id", "source", "size", "order", "source_size", "target"]
    # no bucket holds the place: the rest is the whole source, or nothing of it has a size
    clear = rows.filter("bucket is null or substring(order, 1, %d) <> bucket" % BUCKET_DIGITS)
    clear = clear.select(*cols, F.expr("epochs * size + if(bucket is null, if(rest > 0, size, 0), if(order < bucket, size, 0))").alias("taken"))
    tight = rows.filter("substring(order, 1, %d) = bucket" % BUCKET_DIGITS)
    run = F.sum("size").over(Window.partitionBy("source").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tight = tight.withColumn("upto", F.col("before") + run).select(*cols, F.expr("epochs * size + least(size, greatest(0, rest - (upto - size)))").alias("taken"))
    return clear.unionByName(tight)


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "0", **options) -> DataFrame:
    """docs, all columns: each whole document as often as the mix takes it. The part of a document across the last place counts as one if it is at least half."""
    names = docs.columns
    taken = mix(docs, text, key, source, seed, **options).filter("size > 0").select(F.col("order").alias("_o"), F.expr("cast(floor(taken / size + 0.5) as int)").alias("_n"))
    taken = taken.groupBy("_o").agg(F.sum("_n").alias("_sum"), F.count("*").alias("_rows"))  # rows that repeat an id and a text
    marked = docs.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary")))
    both = marked.join(taken.hint("shuffle_hash"), F.col("_order") == F.col("_o"))
    # among k equal rows each emits its share of what all of them take: all emit the mean, rounded
    each = F.expr("cast(round(_sum / _rows) as int)")
    return both.withColumn("_c", F.explode(F.when(each > 0, F.sequence(F.lit(1), each)))).select(*names)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix(load(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def oracle() -> str:
    return rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as size, md5('0:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as o from documents),
s as (select source, sum(size) as source_size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, 2 * sum(size) as cap from d group by source),
x as (select *, coalesce(sum(cap) over w, 0) as caps, coalesce(sum(weight) over w, 0) as used, sum(weight) over () as weights, sum(source_size) over () as words
      from s window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
y as (select *, (words::double * 1.5 - caps::double) / (weights - used)::double as level from x),
z as (select *, max(case when cap >= level * weight then level end) over () as lev from y),
t as (select source, source_size, case when lev is null then cap::double else least(cap::double, lev * weight) end as target from z),
u as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t),
r as (select d.*, u.source_size, u.target, u.epochs, round(u.target) - u.epochs * u.source_size as rest, sum(size) over (partition by d.source order by o, doc_id, size rows between unbounded preceding and current row) as upto
      from d join u on d.source is not distinct from u.source)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target, cast(epochs * size + least(size, greatest(0, rest - (upto - size))) as bigint) as taken from r"""
