"""Scoring queries: each document against a deterministic corruption of itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..registry import query, table

PAIRS = "with p as (select lang || '/' || doc_id as file, lang as subset, source, text as gt, replace(replace(text, ' the ', ' teh '), ' de ', ' ') as gen from documents where text is not null)"


def pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", spread=True).filter("text is not null")
    gen = F.replace(F.replace("text", F.lit(" the "), F.lit(" teh ")), F.lit(" de "), F.lit(" "))
    return docs.select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("file"), F.col("lang").alias("subset"), "source", F.col("text").alias("gt"), gen.alias("gen"))


WORD_F1 = r"""
, g as (select file, unnest(regexp_extract_all(lower(gen), '\w+')) as w from p), t as (select file, unnest(regexp_extract_all(lower(gt), '\w+')) as w from p),
gc as (select file, w, count(*) as n from g group by all), tc as (select file, w, count(*) as n from t group by all),
inter as (select file, sum(least(gc.n, tc.n)) as k from gc join tc using (file, w) group by file),
f as (select p.file, p.subset, p.source, coalesce(2.0::double * k / ((select count(*) from g where g.file = p.file) + (select count(*) from t where t.file = p.file)), 0.0) as word_f1 from p left join inter using (file))"""


@query(PAIRS + WORD_F1 + " select subset, count(*) as n_files, round(avg(word_f1), 9) as mean_word_f1, arg_min(file, (word_f1, file)) as worst_file from f group by rollup (subset)")
def scoring_rollup(spark, sf_dir):
    p = pairs(spark, sf_dir)
    scored = S.word_f1(p).join(p.select("file", "subset"), "file")
    return S.rollup(scored).withColumn("mean_word_f1", F.round("mean_word_f1", 9))


@query(
    "with s as (select doc_id, regexp_replace(text, '[^ -~]', '?', 'g') as a from documents where text is not null), n as (select doc_id, trim(regexp_replace(lower(a), '[\\s]+', ' ', 'g')) as a, trim(regexp_replace(lower(replace(a, 'th', 't')), '[\\s]+', ' ', 'g')) as b from s) "
    "select doc_id, case when a = '' and b = '' then 1.0::double when a = '' or b = '' then 0.0::double else round(1 - levenshtein(b, a) / greatest(length(a), length(b))::double, 9) end as similarity from n"
)
def edit_similarity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", spread=True).filter("text is not null").select("doc_id", F.regexp_replace("text", "[^ -~]", "?").alias("a"))
    return docs.select("doc_id", F.round(S.similarity(F.replace("a", F.lit("th"), F.lit("t")), F.col("a")), 9).alias("similarity"))


@query(
    r"""with p as (select doc_id as file, text as gt, regexp_replace(regexp_replace(text, '(([^ ]+ ){6}[^ ]+) ', '\1', 'g'), '(([^ ]+ ){9}[^ ]{3})([^ ])', '\1 \3', 'g') as gen from documents where text is not null),
w as (select file, list_transform(list_filter(regexp_split_to_array(lower(gen), '[\s\p{Z}\x{85}]+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')) as g,
             list_transform(list_filter(regexp_split_to_array(lower(gt), '[\s\p{Z}\x{85}]+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')) as t from p),
v as (select distinct file, w from (select file, unnest(t) as w from w) where w <> ''),
c as (select distinct file, a || b as w from (select file, unnest(t[:-2]) as a, unnest(t[2:]) as b from w where len(t) > 1) where length(a) >= 2 and length(b) >= 2),
n as (select file, g[i] as a, g[i + 1] as b from (select file, g, unnest(range(1, len(g) + 1)) as i from w) where g[i] <> '')
select file as doc_id, count(*) filter (b <> '' and (file, a || b) in (select (file, w) from v) and not ((file, a) in (select (file, w) from v) and (file, b) in (select (file, w) from v))) as n_split,
       count(*) filter ((file, a) in (select (file, w) from c) and (file, a) not in (select (file, w) from v)) as n_glued from n group by file"""
)
def spacing_errors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", spread=True).filter("text is not null")
    gen = F.regexp_replace(F.regexp_replace("text", "(([^ ]+ ){6}[^ ]+) ", "$1"), "(([^ ]+ ){9}[^ ]{3})([^ ])", "$1 $3")
    return S.spacing_errors(docs.select(F.col("doc_id").alias("file"), F.col("text").alias("gt"), gen.alias("gen"))).withColumnRenamed("file", "doc_id")


MARKDOWN = r"""with m as (select page_id as file, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as h, regexp_extract(html, '<title>([^<]*)</title>', 1) as t from pages),
p as (select file, '# ' || h || chr(10) || chr(10) || 'text' || chr(10) || '## [' || t || '](x)' as gt, case when file % 3 = 0 then '## ' else '# ' end || h || chr(10) || '## ' || t as gen from m)"""


@query(
    MARKDOWN
    + r""", e as (select file, gen, gt, regexp_split_to_array(gen, '\n') as a, regexp_split_to_array(gt, '\n') as b from p),
k as (select file, 'g' as side, unnest(a) as line from e union all select file, 't', unnest(b) from e),
h as (select file, side, regexp_extract(line, '^(#{1,6})\s+(.*)$', 1) || ' ' || lower(trim(regexp_replace(regexp_replace(regexp_extract(line, '^(#{1,6})\s+(.*)$', 2), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[^\p{L}\p{Nd}]+', ' ', 'g'))) as x
      from k where regexp_matches(line, '^#{1,6}\s+.*[\p{L}\p{Nd}]')),
c as (select file, x, count(*) filter (side = 'g') as g, count(*) filter (side = 't') as t from h group by all),
s as (select file, sum(g) as ng, sum(t) as nt, sum(least(g, t)) as k from c group by file)
select p.file as page_id, case when ng is null then 1.0::double when k = 0 then 0.0::double else 2.0::double * k / (ng + nt) end as heading_f1 from p left join s using (file)"""
)
def heading_f1(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"))
    gt = F.concat(F.lit("# "), "h", F.lit("\n\ntext\n## ["), "t", F.lit("](x)"))
    gen = F.concat(F.when(F.col("file") % 3 == 0, "## ").otherwise("# "), "h", F.lit("\n## "), "t")
    return S.heading_f1(pages.select("file", gen.alias("gen"), gt.alias("gt"))).withColumnRenamed("file", "page_id")


@query(
    "with b as (select source as file, avg(n_chars) / 10000 as score from documents group by source), s as (select source as file, avg(n_chars) / 10000 - case when source like '%3' then 0.05 when source like '%4' then 0.01 else 0 end as score from documents where source not like '%7' group by source) "
    "select b.file, round(b.score, 9) as want, round(s.score, 9) as got from b left join s using (file) where s.score is null or s.score < b.score - 0.02"
)
def regression_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), "n_chars")
    base = docs.groupBy("file").agg((F.avg("n_chars") / 10000).alias("score"))
    less = F.when(F.col("file").like("%3"), 0.05).when(F.col("file").like("%4"), 0.01).otherwise(0.0)
    scores = base.filter(~F.col("file").like("%7")).withColumn("score", F.col("score") - less)
    out = S.regressions(base, scores)
    return out.select("file", F.round("want", 9).alias("want"), F.round("got", 9).alias("got"))
