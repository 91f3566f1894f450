"""Benchmark decontamination: a hash set of benchmark n-grams, looked up for every window of every document. DataFrame functions only.

A window is `width` consecutive words of an item; an item with fewer words, but not none, is one window. The windows are
distinct rows (hash, text, items). Documents become one row per window start, and a join on the hash finds candidates,
which count only where the texts agree. The hash set is broadcast if it holds at most `broadcast_rows` windows; beyond
that the starts are shuffled by their hash instead, and candidates verified against the document afterwards.

Skew: with the broadcast nothing is shuffled but hits, grouped per document, whose number is bounded by its words.

Edge cases: null and empty texts have no words: as documents they are clean, as items they have no windows. Each row of
documents is judged for itself, also where doc_id repeats or is null. Items with equal windows are all reported; items
that repeat an id count once; an item without an id hits words, but is not among the items. An empty benchmark hits nothing. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NONWORD, SQL_WORDS, load, word_array

WIDTH = 10
BROADCAST_ROWS = 1_000_000


def windows(items: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """h, len, gram, items: the distinct windows."""
    w = items.select(F.col(key).cast("string").alias("item"), word_array(F.col(text)).alias("words")).filter(F.size("words") > 0)
    w = w.withColumn("len", F.least(F.size("words"), F.lit(width))).withColumn("i", F.explode(F.expr("sequence(1, size(words) - len + 1)")))
    w = w.select(F.expr("slice(words, i, len)").alias("g"), "len", "item").select(F.xxhash64("g").alias("h"), "len", F.array_join("g", " ").alias("gram"), "item")
    return w.groupBy("h", "len", "gram").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: key, n_words, spans (hit intervals of words, merged; from 0, end exclusive), items (sorted)."""
    grams = windows(benchmark, item_text, item_key, width)
    sizes = {r["len"]: r["n"] for r in grams.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most `width` rows
    lens = sorted(sizes) or [width]
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("id"), word_array(F.col(text)).alias("words"))
    k = len(lens)
    # start c means place c div k for length number c % k; -1 stands for the document itself and meets the set's marker row
    at = base.select("rid", "id", "words", F.size("words").alias("n"), F.explode(F.expr(f"sequence(-1, size(words) * {k} - 1)")).alias("c"))
    at = at.withColumn("i", F.expr(f"c div {k} + 1")).withColumn("l", F.expr(f"element_at(array({', '.join(map(str, lens))}), cast(greatest(c, 0) % {k} + 1 as int))"))
    at = at.filter("c < 0 or i + l - 1 <= n").withColumn("at_h", F.when(F.col("c") < 0, F.lit(0)).otherwise(F.xxhash64(F.expr("slice(words, cast(i as int), l)"))))
    marker = docs.sparkSession.sql("select 0L as h, 0 as len, cast(null as string) as gram, cast(array() as array<string>) as items")
    same = F.expr("(c < 0 and gram is null) or (c >= 0 and l = len and gram = array_join(slice(words, cast(i as int), l), ' '))")
    if sum(sizes.values()) <= broadcast_rows:
        found = at.join(F.broadcast(grams.unionByName(marker)), (F.col("at_h") == F.col("h")) & same)
    else:
        # only keys travel to the set; the window's text is compared once the few candidates are back at their document.
        # Row numbers may differ between two readings, so id and text find the document again; equal rows are judged alike.
        own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), word_array(F.col(text)).alias("words"))
        at = own.select("id", "t", "words", F.size("words").alias("n"), F.explode(F.expr(f"sequence(-1, size(words) * {k} - 1)")).alias("c")).filter("c >= 0")
        at = at.withColumn("i", F.expr(f"c div {k} + 1")).withColumn("l", F.expr(f"element_at(array({', '.join(map(str, lens))}), cast(c % {k} + 1 as int))")).filter("i + l - 1 <= n")
        at = at.select("id", "t", "i", "l", F.xxhash64(F.expr("slice(words, cast(i as int), l)")).alias("at_h"))
        near = at.hint("merge").join(grams, (F.col("at_h") == F.col("h")) & (F.col("l") == F.col("len")))
        per = near.groupBy(F.col("id").alias("id2"), F.col("t").alias("t2")).agg(F.collect_set(F.struct("i", "l", "gram", "items")).alias("cand"))
        both = own.join(per, own["id"].eqNullSafe(per["id2"]) & (own["t"] == per["t2"]), "left").select("rid", "id", F.size("words").alias("n"), F.expr("filter(cand, x -> x.gram = array_join(slice(words, cast(x.i as int), x.l), ' '))").alias("ok"))
        empty = "named_struct('i', 0L, 'l', 0, 'gram', cast(null as string), 'items', cast(array() as array<string>))"
        found = both.select("rid", "id", "n", F.explode(F.expr(f"concat(array({empty}), coalesce(ok, array()))")).alias("x")).selectExpr("rid", "id", "n", "if(x.l = 0, -1L, 0L) as c", "x.i as i", "x.l as l", "x.items as items")
    found = found.select("rid", "id", "n", F.expr("if(c < 0, null, struct(cast(i - 1 as bigint) as s, cast(i - 1 + l as bigint) as e))").alias("hit"), "items")
    per = found.groupBy("rid", "id", "n").agg(F.array_sort(F.collect_set("hit")).alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = """aggregate(h, cast(array() as array<struct<s:bigint,e:bigint>>), (a, x) -> if(size(a) > 0 and x.s <= a[size(a) - 1].e,
        concat(slice(a, 1, size(a) - 1), array(named_struct('s', a[size(a) - 1].s, 'e', greatest(a[size(a) - 1].e, x.e)))), array_append(a, x)))"""
    return per.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_words"), F.expr(merged).alias("spans"), "items", "rid")


def report(found: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.e - x.s)")
    return found.select(*(c for c in found.columns if c not in ("n_words", "spans", "items", "rid")), "n_words", n_hit.alias("n_hit"), F.expr("cast(size(items) as bigint)").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs, all columns, without contaminated documents (mode "documents") or without the hit words and what follows each up to the next word ("spans").

    Rows with the same key and text are judged alike; a null key equals a null key.
    """
    found = hits(docs.select(F.struct(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h")).alias("_row"), F.col(text).alias("_t")), benchmark, text="_t", key="_row", **options)
    bad = found.filter(F.size("spans") > 0).groupBy("_row").agg(F.first("spans").alias("_spans")).select(F.col("_row.k").alias("_k"), F.col("_row.h").alias("_h"), "_spans")
    bad = bad.hint("shuffle_hash")
    on = docs[key].eqNullSafe(F.col("_k")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("_h"))
    if mode == "documents":
        return docs.join(bad, on, "left_anti")
    both = docs.join(bad, on, "left")
    word = NONWORD.replace("[", "[^", 1)
    pieces = F.expr(f"regexp_extract_all(`{text}`, '({word.replace(chr(92), chr(92) * 2)}{NONWORD.replace('+', '*').replace(chr(92), chr(92) * 2)})', 1)")
    lead = F.expr(f"regexp_extract(`{text}`, '^({NONWORD.replace('+', '*').replace(chr(92), chr(92) * 2)})', 1)")
    cut = both.withColumn("_p", F.when(F.col("_spans").isNotNull(), pieces))
    # the words between the spans, in order: gap k runs from the end of span k to the start of the next
    between = "concat(array(slice(_p, 1, cast(_spans[0].s as int))), transform(_spans, (x, i) -> slice(_p, cast(x.e + 1 as int), cast(if(i + 1 < size(_spans), _spans[i + 1].s, size(_p)) - x.e as int))))"
    cut = cut.withColumn("_p", F.expr(f"array_join(flatten({between}), '')"))
    return cut.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.concat(lead, "_p"))).select(*docs.columns)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(hits(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


def oracle() -> str:
    return rf"""
with i as (select cast(item_id as varchar) as item, {SQL_WORDS} as w from benchmark),
g as (select item, w[j:j + least(len(w), {WIDTH}) - 1] as gram, least(len(w), {WIDTH}) as l
      from (select item, w, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) as j from i where len(w) > 0)),
d as (select doc_id, {SQL_WORDS} as w from documents),
p as (select doc_id, w, len(w) as n, unnest(range(1, len(w) + 1)) as j from d),
k as (select doc_id, j, ls.l, item from p cross join (select distinct l from g) ls join g on g.l = ls.l and g.gram = p.w[p.j:p.j + ls.l - 1] where p.j + ls.l - 1 <= p.n),
h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(j, j + l)) as q from k) group by 1),
m as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from k group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated from d left join h using (doc_id) left join m using (doc_id)"""
