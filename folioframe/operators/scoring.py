"""Quality metrics of generated text against ground truth. Input rows: file, gen, gt; one pass per metric, keyed by file."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions import edits

BLANKS = r"[\s\p{Z}\x{85}]+"
HEADING = r"(?m)^(#{1,6})\s+(.*)$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), BLANKS, " "))


@F.arrow_udf(LongType())
def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of whole texts, whatever their length: the built-in levenshtein takes time and memory with the product of the lengths."""
    return edits.distances(a, b)


def similarity(gen: Column, gt: Column) -> Column:
    """1 - edit distance / longer length of the normalised texts; 1 for two empty ones, 0 if one is."""
    a, b = normalised(gen), normalised(gt)
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - edit_distance(a, b) / longest)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0))


def headings(md: Column, with_level: bool) -> Column:
    """Heading lines as text, without link targets and marks; with_level puts the number of # before."""
    level, text = F.regexp_extract_all(md, F.lit(HEADING), F.lit(1)), F.regexp_extract_all(md, F.lit(HEADING), F.lit(2))
    clean = F.transform(text, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[^\p{L}\p{Nd}]+", " ")))
    both = F.zip_with(level, F.transform(clean, F.lower), lambda a, b: F.when(b != "", F.concat(a, F.lit(" "), b) if with_level else b))
    return F.filter(both, lambda x: x.isNotNull())


def multiset_f1(pairs: DataFrame, gen_items: Column, gt_items: Column, name: str, both_empty: float = 0.0) -> DataFrame:
    """file, name: 2 * shared / (items of both), shared counted with multiplicity. Signed rows make it one shuffle, no join."""
    side = lambda items, g, t: F.transform(items, lambda x: F.struct(x.alias("item"), F.lit(g).alias("g"), F.lit(t).alias("t")))
    rows = pairs.select("file", F.explode_outer(F.concat(side(gen_items, 1, 0), side(gt_items, 0, 1))).alias("r")).select("file", "r.*")
    per = rows.groupBy("file", "item").agg(F.sum("g").alias("g"), F.sum("t").alias("t"))
    f = per.groupBy("file").agg(F.sum("g").alias("ng"), F.sum("t").alias("nt"), F.sum(F.least("g", "t")).alias("both"))
    return f.select("file", F.when(F.col("ng").isNull(), F.lit(both_empty)).when(F.coalesce("both", F.lit(0)) == 0, 0.0).otherwise(2 * F.col("both") / (F.col("ng") + F.col("nt"))).alias(name))


def word_f1(pairs: DataFrame) -> DataFrame:
    return multiset_f1(pairs, words(F.col("gen")), words(F.col("gt")), "word_f1")


def heading_f1(pairs: DataFrame, with_level: bool = True) -> DataFrame:
    return multiset_f1(pairs, headings(F.col("gen"), with_level), headings(F.col("gt"), with_level), "heading_f1" if with_level else "heading_text_f1", both_empty=1.0)


def rollup(scores: DataFrame, subset: str = "subset", metrics: tuple[str, ...] = ("word_f1",)) -> DataFrame:
    """Means per subset and over all (subset null), the number of files, and the worst file of each by the first metric."""
    aggs = [F.avg(m).alias(f"mean_{m}") for m in metrics]
    return scores.rollup(subset).agg(F.count("*").alias("n_files"), *aggs, F.min_by("file", F.struct(metrics[0], "file")).alias("worst_file"))


def spacing_marks(pairs: DataFrame) -> DataFrame:
    """file, pos, a, b (the next token), split, glued, and at: after how many letters of a glued token the blank is missing.

    A break: two neighbouring tokens, set apart by blanks only, make a word of the ground truth and are not both its words.
    A gluing: a token that is no word of the ground truth is two neighbouring words of it run together, each of two letters
    or more; counted once for each token that stands in the text.
    """
    letters = lambda c: F.filter(F.split(F.lower(c), BLANKS), lambda t: F.length(t) > 0)
    bare = lambda c: F.transform(c, lambda t: F.regexp_replace(t, r"^[^a-z0-9]+|[^a-z0-9]+$", ""))
    p = pairs.select("file", bare(letters(F.col("gen"))).alias("g"), bare(letters(F.col("gt"))).alias("t"))
    p = p.select("file", F.array("g").alias("g"), F.array("t").alias("t"))
    if not pairs.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():  # rows of one file share its words
        p = p.groupBy("file").agg(F.flatten(F.collect_list("g")).alias("g"), F.flatten(F.collect_list("t")).alias("t"))
    kind = dict(pairs.dtypes)["file"]
    return p.mapInArrow(marked, f"file {kind}, pos int, a string, b string, split boolean, glued boolean, at int")


def marked(batches):
    """The marks of each file, whose texts are lists of tokens; a file's words never leave its row. A file with tokens but no mark has one row that marks nothing."""
    for batch in batches:
        at, rows = [], []
        for i in range(batch.num_rows):
            gen, truth = ([t or [] for t in batch.column(c)[i].as_py() or []] for c in (1, 2))
            vocab, glue, out = {w for t in truth for w in t if w}, {}, []
            for t in truth:
                for x, y in zip(t, t[1:]):
                    if len(x) >= 2 and len(y) >= 2:
                        glue[x + y] = min(len(x), glue.get(x + y, len(x)))
            for g in gen:
                for pos, (x, y) in enumerate(zip(g, [*g[1:], None])):
                    if x:
                        split, glued = bool(y) and x + y in vocab and not (x in vocab and y in vocab), x in glue and x not in vocab
                        if split or glued:
                            out.append((pos, x, y, split, glued, glue.get(x)))
            if not out and any(x for g in gen for x in g):
                out.append((0, "", None, False, False, None))
            at += [i] * len(out)
            rows += out
        kinds = (pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32())
        cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], ["file", "pos", "a", "b", "split", "glued", "at"])


def spacing_errors(pairs: DataFrame) -> DataFrame:
    """file, n_split, n_glued: words broken by a space that should not be there, and words run together."""
    g = spacing_marks(pairs)
    return g.groupBy("file").agg(F.sum(F.col("split").cast("long")).alias("n_split"), F.sum(F.col("glued").cast("long")).alias("n_glued"))


def spacing_examples(pairs: DataFrame, most: int) -> DataFrame:
    """file, nth (from 1), example: the first `most` errors of each file, with | where the blank is wrong or missing. A broken word stands where its second part does."""
    g = spacing_marks(pairs).filter("split or glued")
    at = F.array(F.struct((F.col("pos") + 1).alias("place"), F.lit(0).alias("kind"), F.when(F.col("split"), F.concat(F.lit("split: "), "a", F.lit("|"), "b")).alias("example")), F.struct(F.col("pos").alias("place"), F.lit(1).alias("kind"), F.when(F.col("glued"), F.concat(F.lit("glued: "), F.expr("substr(a, 1, at)"), F.lit("|"), F.expr("substr(a, at + 1)"))).alias("example")))
    rows = g.select("file", F.explode(F.filter(at, lambda x: x["example"].isNotNull())).alias("x"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("x.place", "x.kind"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most).select("file", "nth", "x.example")


def regressions(base: DataFrame, scores: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """file, want, got: files of the baseline that are missing or worse than it by more than the tolerance."""
    both = base.select("file", F.col("score").alias("want")).join(scores.select("file", F.col("score").alias("got")), "file", "left")
    return both.filter(F.col("got").isNull() | (F.col("got") < F.col("want") - tolerance))


def read_baseline(spark, path: str) -> DataFrame:
    """A baseline file {dataset, tool, scores: {file: score}} as rows dataset, tool, file, score."""
    raw = spark.read.schema("dataset string, tool string, scores map<string,double>").option("multiLine", True).json(path)
    return raw.select("dataset", "tool", F.explode("scores").alias("file", "score"))


def write_baseline(scores: DataFrame, path: str, dataset: str, tool: str) -> None:
    """The other way; refuses to write a baseline without scores."""
    if scores.isEmpty():
        raise ValueError("no scores to write")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "score"))))
    scores.agg(F.lit(dataset).alias("dataset"), F.lit(tool).alias("tool"), entries.alias("scores")).coalesce(1).write.mode("overwrite").json(path)


def below(path: Column, root: str) -> Column:
    """A file's path below root, whatever scheme both are written with."""
    plain = re.sub("^[a-z0-9]+:/+", "/", root.rstrip("/"))
    return F.regexp_replace(F.regexp_replace(path, "^[a-z0-9]+:/+", "/"), r"^\Q" + plain + r"\E/", "")


def ground_truth_pairs(spark, root: str, suffix: str = "md") -> DataFrame:
    """file, gt: texts <subset>/markdown/<name> below root, named like the page files they belong to, <subset>/pdf/<name>.pdf."""
    texts = spark.read.option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).text(root, wholetext=True)
    file = F.regexp_replace(below(F.input_file_name(), root), rf"^([^/]*)/markdown/(.*)\.{suffix}$", "$1/pdf/$2.pdf")
    return texts.select(file.alias("file"), F.col("value").alias("gt")).filter(F.regexp_like("file", F.lit(r"^[^/]*/pdf/.*\.pdf$")))
