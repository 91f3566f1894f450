"""Licence scan: ordered signature rules, gated by keywords, resolved by priority and containment. DataFrame functions only.

A text becomes its words with two spaces between them, so a rule's match always covers whole words and a position is a
count of words. A document without any anchor word costs one pass; in the others each rule whose keyword occurs runs
once, and what it matches becomes intervals of words. One interval suppresses another that it contains, if its rule ranks
before the other's; containment and rank are both transitive, so "suppressed by any" equals the greedy order.

Everything happens inside a row: no shuffle, no state, so a hot source or a group of copies makes no difference.

Edge cases: a null or empty text has no words, no labels and score 0; a text of only separators likewise. Rows are
independent: repeated rows give repeated results, an empty table an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, word_count, word_string
from .license_rules import Rule, anchors, rules

#: Places of these words in a row count as base detections: words, label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
DETECTION = "struct<s:bigint,neg:bigint,rank:int,label:string,confidence:double>"


def places(pattern: str) -> str:
    """SQL for the words at which the matches of a pattern start, and for the matches. A mark is set before each first word; words never hold it."""
    return f"filter(transform(split(trim(regexp_replace(w, {pattern}, ' \\u0001$1 ')), '  '), (x, i) -> if(startswith(x, '\\u0001'), cast(i as bigint), null)), x -> x is not null)"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def license_scan(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), of: list[Rule] | None = None, phrases=PHRASES) -> DataFrame:
    """keys, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (those not suppressed: first word, end, label, rank, confidence)."""
    of = rules() if of is None else of
    table = json.dumps([{"rank": r.rank, "label": r.label, "keyword": r.keyword, "pattern": r.pattern, "confidence": r.confidence} for r in of])
    gate = anchors(of) + [p.split(" ")[0] for p, _ in phrases if len(phrases) > 8]
    base = [("  ".join(p.split(" ")), label) for p, label in phrases]
    out = docs.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), word_string(F.col(text)).alias("cased"))
    out = out.withColumn("lowered", F.lower("cased"))  # for the gate only: it may change letters beyond ASCII, but keeps each ASCII word
    held = F.lit(False)
    for a in gate:
        held |= F.contains("lowered", F.lit(a))
    for p, _ in base:
        held |= F.contains("lowered", F.lit(p))
    out = out.select("*", word_count(F.col("cased")).alias("n_words"), F.when(held, ascii_lower(F.col("cased"))).alias("w")).drop("lowered", "cased")
    # a phrase may overlap itself, so all but its first word are only looked at
    hits = []
    for p, label in base:
        first, _, rest = p.partition("  ")
        ahead = f"(?= {rest} )" if rest else ""
        hits.append(f"transform({places(literal(f' ({first}) {ahead}'))}, x -> struct(x as s, {literal(label)} as label))")
    out = out.withColumn("base", F.expr(f"if(w is null, cast(array() as array<struct<s:bigint,label:string>>), concat({', '.join(hits) or 'array()'}))"))
    rule = "from_json({}, 'array<struct<rank:int,label:string,keyword:string,pattern:string,confidence:double>>')".format(literal(table))
    words = "cast((octet_length(m) - octet_length(replace(m, '  ', ''))) div 2 + 1 as bigint)"
    one = f"zip_with({places('r.pattern')}, transform(regexp_extract_all(w, r.pattern, 1), m -> {words}), (s, n) -> named_struct('s', s, 'neg', -(s + n), 'rank', r.rank, 'label', r.label, 'confidence', r.confidence))"
    found = f"array_sort(flatten(transform(filter({rule}, r -> contains(w, r.keyword)), r -> {one})))"
    out = out.withColumn("found", F.expr(f"if(w is null, cast(array() as array<{DETECTION}>), cast({found} as array<{DETECTION}>))"))
    # left to right: an interval that contains d has begun, so it is among those still open
    kept = f"""aggregate(found, named_struct('open', cast(array() as array<struct<neg:bigint,rank:int>>), 'kept', cast(array() as array<{DETECTION}>)),
        (a, d) -> named_struct('open', array_append(filter(a.open, e -> -e.neg > d.s), named_struct('neg', d.neg, 'rank', d.rank)),
            'kept', if(exists(a.open, e -> e.neg <= d.neg and e.rank < d.rank), a.kept, array_append(a.kept, d))), a -> a.kept)"""
    out = out.withColumn("kept", F.expr(f"if(size(found) = 0, found, {kept})"))
    return out.select(
        *(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), "n_words",
        F.expr("cast(size(base) as bigint)").alias("n_base"), F.expr("array_min(base.s)").alias("first_word"), F.expr("array_max(base.s)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(base.label)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_union(base.label, kept.label)), ',')").alias("labels"),
        F.expr("greatest(if(size(base) > 0, 1D, 0D), coalesce(array_max(kept.confidence), 0D))").alias("score"),
        F.expr("transform(kept, d -> named_struct('first_word', d.s, 'end_word', -d.neg, 'label', d.label, 'rank', d.rank, 'confidence', d.confidence))").alias("detections"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")


def oracle() -> str:
    """The same in DuckDB: rules as rows, joined to documents, intervals suppressed by an anti join."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",".join(f"({r.rank}, {quote(r.label)}, {quote(r.keyword)}, {quote(r.pattern)}, {r.confidence}::double)" for r in rules())
    bases = ",".join(f"({quote(' (' + '  '.join(p.split(' ')) + ') ')}, {quote(label)})" for p, label in PHRASES)
    starts = "list_filter(list_transform(string_split(trim(regexp_replace(w, pattern, ' \x01\\1 ', 'g')), '  '), lambda x, i: case when x[1] = '\x01' then i - 1 end), lambda x: x is not null)"
    return rf"""
with rules(rank, label, keyword, pattern, confidence) as (values {values}), bases(pattern, label) as (values {bases}),
t as (select doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g'), ' ') as j from documents),
d as (select doc_id, case when j = '' then '' else ' ' || j || ' ' end as w, case when j = '' then 0 else len(string_split(j, '  ')) end as n_words from t),
b as (select doc_id, label, unnest({starts}) as s from d, bases where contains(w, replace(replace(trim(pattern), '(', ''), ')', ''))),
f as (select doc_id, rank, label, confidence, unnest({starts}) as s, unnest(list_transform(regexp_extract_all(w, pattern, 1), lambda m: len(string_split(m, '  ')))) as n
      from d, rules where contains(w, keyword)),
k as (select * from f where not exists (select 1 from f as o where o.doc_id = f.doc_id and o.rank < f.rank and o.s <= f.s and o.s + o.n >= f.s + f.n)),
bb as (select doc_id, count(*) as n_base, min(s) as first_word, max(s) as last_word, string_agg(distinct label, ',' order by label) as base_labels from b group by 1),
ll as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from b union all select doc_id, label from k) group by 1),
kk as (select doc_id, max(confidence) as confidence from k group by 1)
select d.doc_id, cast(n_words as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       greatest(case when n_base > 0 then 1.0::double else 0.0::double end, coalesce(confidence, 0.0::double)) as score
from d left join bb using (doc_id) left join ll using (doc_id) left join kk using (doc_id)"""
