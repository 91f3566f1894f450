"""Layout queries over geometry derived from `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.dialect import DUCK, SPARK
from ..operators import layout as L
from ..registry import query, table
from ..sources import derived

BLOCKS = derived.SQL
STYLED = BLOCKS + f", elements as (select doc_id, page, ord, 'paragraph' as type, {P.styled(DUCK, 'text', 'font_name')} as content, 0 as level, x, y, width, height, font_size, space_width, false as bold from blocks)"
#: Types by rule, so that runs of each kind occur.
KIND = "case when ((ord {div} 2) + doc_id) % 5 < 2 then 'header' when ((ord {div} 3) + doc_id) % 4 = 0 then 'code_block' when ((ord {div} 3) + doc_id) % 4 = 1 then 'table' else 'paragraph' end"
BOLD = "((ord {div} 4) + doc_id) % 3 = 0"
NUMBERED = "case when (ord {div} 3 + doc_id) % 3 = 0 then concat(cast(ord + 1 as {string}), '. Step') else text end"
TYPED = BLOCKS + f", elements as (select doc_id, page, ord, {KIND.format(div='//')} as type, {NUMBERED.format(div='//', string='varchar')} as content, 1 as level, x, y, width, height, 12.0::double as font_size, space_width, {BOLD.format(div='//')} as bold, 12.0::double as body from blocks)"


def blocks(spark, sf_dir):
    return derived.text_blocks(table(spark, sf_dir, "documents", spread=True))


def elements(spark, sf_dir):
    return L.as_elements(blocks(spark, sf_dir))


def typed(spark, sf_dir):
    b = blocks(spark, sf_dir)
    kind, bold, text = (F.expr(s.format(div="div", string="string")) for s in (KIND, BOLD, NUMBERED))
    return b.select("doc_id", "page", "ord", kind.alias("type"), text.alias("content"), F.lit(1).alias("level"), "x", "y", "width", "height", F.lit(12.0).alias("font_size"), "space_width", bold.alias("bold"), F.lit(12.0).alias("body"))


@query(BLOCKS + " select doc_id, page, ord, text from blocks where not (y < 530 or y > 792 - 20)")
def exclusion_zone(spark, sf_dir):
    return L.exclusion_zone(blocks(spark, sf_dir), 792, 20, 530).select("doc_id", "page", "ord", "text")


@query(STYLED + " select doc_id, ord, content from elements")
def style_markup(spark, sf_dir):
    return elements(spark, sf_dir).select("doc_id", "ord", "content")


def text_filter(name: str, keep: bool = True, variant: str = "text"):
    """The blocks whose text (or a variant of it, so that the rule finds something) a predicate keeps."""
    builder = getattr(P, name)

    @query(BLOCKS + f", v as (select doc_id, ord, {variant} as text from blocks) select doc_id, ord, text from v where {'' if keep else 'not '}{builder(DUCK, 'text')}", name=f"{name}_filter")
    def run(spark, sf_dir):
        return blocks(spark, sf_dir).select("doc_id", "ord", F.expr(variant).alias("text")).filter(F.expr(("" if keep else "not ") + builder(SPARK, "text")))


for _name in ("list_item", "numbered_header", "caps_heading", "admonition", "code_line", "author_block", "table_row"):
    text_filter(_name)
text_filter("numeric_cell", variant="case when ord % 2 = 0 then concat(cast(ord as string), '.5%') else text end")
text_filter("lettered_italic", variant="concat('*A. ', substr(md5(text), 1, 12), '*')")
text_filter("math_text", variant="case when ord % 2 = 0 then concat('α∑', substr(md5(text), 1, 3)) else text end")
text_filter("page_number", keep=False, variant="case when ord % 5 = 0 then concat('- ', cast(ord as string), ' -') else text end")


@query(BLOCKS + f" select doc_id, ord, cast({P.equation_score(DUCK, 'text')} as integer) as score from blocks")
def equation_score(spark, sf_dir):
    return blocks(spark, sf_dir).select("doc_id", "ord", F.expr(P.equation_score(SPARK, "text")).cast("int").alias("score"))


@query(BLOCKS + f" select doc_id, page, avg({P.equation_score(DUCK, 'text')} + case when {P.math_font(DUCK, 'font_name')} then 2 else 0 end) > 1.5 as equation from blocks group by doc_id, page")
def equation_groups(spark, sf_dir):
    score = F.expr(P.equation_score(SPARK, "text")) + F.when(F.expr(P.math_font(SPARK, "font_name")), 2).otherwise(0)
    return blocks(spark, sf_dir).groupBy("doc_id", "page").agg((F.avg(score) > 1.5).alias("equation"))


@query(BLOCKS + ", n as (select doc_id, font_size, sum(length(text)) as n from blocks where font_size > 0 group by all), r as (select *, row_number() over (partition by doc_id order by n desc, font_size) as k from n) select doc_id, font_size as body from r where k = 1")
def body_font_size(spark, sf_dir):
    return L.body_font_size(blocks(spark, sf_dir))


LINKS = "select doc_id, page, k as link_ord, concat('u', cast(k as {string})) as uri, cast(80 + 60 * k as double) as x1, cast(790 - 40 * k as double) as y1, cast(200 + 90 * k as double) as x2, cast(760 - 40 * k as double) as y2"


@query(
    BLOCKS
    + ", pg as (select distinct doc_id, page from blocks), links as ("
    + LINKS.format(string="varchar")
    + """ from pg, (values (0), (1), (2), (1)) as v(k)), c as (select b.doc_id, b.page, b.ord, uri, link_ord, least(b.x + b.width, greatest(x1, x2)) - greatest(b.x, least(x1, x2)) as w,
least(b.y + b.height, greatest(y1, y2)) - greatest(b.y, least(y1, y2)) as h, b.width * b.height as own, abs(x2 - x1) * abs(y2 - y1) as other from blocks b join links using (doc_id, page)),
m as (select doc_id, ord, arg_min(uri, link_ord) as link_uri from c where w > 0 and h > 0 and (w * h / nullif(other, 0) > 0.3 or w * h / nullif(own, 0) > 0.3) group by all)
select b.doc_id, b.ord, m.link_uri from blocks b left join m using (doc_id, ord)"""
)
def link_blocks(spark, sf_dir):
    b = blocks(spark, sf_dir)
    v = b.select("doc_id", "page").distinct().withColumn("k", F.explode(F.array(*map(F.lit, (0, 1, 2, 1)))))
    links = v.selectExpr("doc_id", "page", "k as link_ord", "concat('u', cast(k as string)) as uri", "80D + 60 * k as x1", "790D - 40 * k as y1", "200D + 90 * k as x2", "760D - 40 * k as y2")
    return L.apply_links(b, links).select("doc_id", "ord", "link_uri")


@query(
    BLOCKS
    + """, g as (select doc_id, page, 0 as go, 60.0 as gx, 600.0 as gy, 300.0 as gw, 120.0 as gh from (select distinct doc_id, page from blocks) union all select doc_id, page, 1, 60.0, 700.0, 200.0, 60.0 from (select distinct doc_id, page from blocks)),
f as (select * from g where not exists (select 1 from blocks b where b.doc_id = g.doc_id and b.page = g.page and b.font_size >= 0.9 * 16 and b.x + b.width / 2 between gx and gx + gw and b.y between gy and gy + gh))
select doc_id, ord from blocks b where not exists (select 1 from f where f.doc_id = b.doc_id and f.page = b.page and b.font_size < 0.7 * 16 and b.x + b.width / 2 between gx and gx + gw and b.y between gy and gy + gh)"""
)
def figure_label_drop(spark, sf_dir):
    b = blocks(spark, sf_dir)
    pages = b.select("doc_id", "page").distinct()
    box = lambda df, o, *v: df.select("doc_id", "page", F.lit(o).alias("ord"), *(F.lit(float(x)).alias(c) for c, x in zip(("x", "y", "width", "height"), v)))
    graphics = box(pages, 0, 60, 600, 300, 120).union(box(pages, 1, 60, 700, 200, 60))
    return L.drop_figure_text(b, graphics, F.lit(16.0)).select("doc_id", "ord")


def _gutter_sql(start: str, end: str, bins: int) -> str:
    return (
        BLOCKS
        + f""", s as (select doc_id, page, {start} as a, {end} as b, min({start}) over (partition by doc_id, page) as a0 from blocks),
h as (select doc_id, page, cast(unnest(range(cast(floor((a - a0) / 2) as bigint), cast(floor((b - a0) / 2) as bigint) + 1)) as bigint) as bin from s),
n as (select doc_id, page, bin, count(*) as n from h group by all), top as (select doc_id, page, max(bin) as m from h group by all),
d as (select t.doc_id, t.page, r.bin, coalesce(n.n, 0) as n from (select doc_id, page, m, unnest(range(0, m + 1)) as bin from top) r join top t using (doc_id, page) left join n on n.doc_id = r.doc_id and n.page = r.page and n.bin = r.bin),
w as (select doc_id, page, bin, sum(n) over v as density, count(*) over v as k from d window v as (partition by doc_id, page order by bin rows between current row and {bins - 1} following))
select doc_id, page, arg_min(bin, (density, bin)) as bin, cast(min(density) as bigint) as density from w where k = {bins} group by all"""
    )


@query(_gutter_sql("x", "x + width", 8))
def gutter_histogram(spark, sf_dir):
    return L.gutter(blocks(spark, sf_dir), F.col("x"), F.col("x") + F.col("width"), 8)


@query(_gutter_sql("y", "y + height", 4))
def row_gutter(spark, sf_dir):
    return L.gutter(blocks(spark, sf_dir), F.col("y"), F.col("y") + F.col("height"), 4)


@query(
    BLOCKS
    + f""", b as (select doc_id, case when n is null then 0 else font_size end as body from (select distinct doc_id from blocks) left join (select doc_id, font_size, sum(length(text)) as n, row_number() over (partition by doc_id order by sum(length(text)) desc, font_size) as k from blocks group by doc_id, font_size) using (doc_id) where k = 1),
e as (select doc_id, page, ord, x, font_size, body, content, {DUCK.trim('content')} as t from (select *, {P.styled(DUCK, 'text', 'font_name')} as content from blocks) join b using (doc_id)),
p as (select *, {P.unbolded(DUCK, 't')} as plain, regexp_replace(t, '^\\*\\*', '') as bare, trim(regexp_replace(t, '^\\*\\*|\\*\\*$', '', 'g')) as inn from e),
r as (select *, case when t = '' then 'none' when {P.admonition(DUCK, 't')} then 'admonition' when {P.code_line(DUCK, 't')} then 'code_block' when {P.table_row(DUCK, 't')} then 'table' when {P.numbered_header(DUCK, 'plain')} then 'numbered'
  when {P.lettered_italic(DUCK, 't')} then 'lettered' when {P.caps_heading(DUCK, 'plain')} then 'capitals' when {P.list_item(DUCK, 't')} then 'list'
  when font_size > body * 1.2 and (regexp_matches(bare, '^[\\s\\p{{Z}}]*\\p{{Ll}}') or not regexp_matches(bare, '[\\p{{L}}\\p{{Nd}}]')) then 'ornament' when font_size > body * 1.2 then 'size'
  when t like '**%' and t like '%**' and strlen(inn) between 3 and 99 and not regexp_matches(inn, '^[0-9]|[.,;]$') then 'bold' else 'plain' end as rule from p),
v as (select *, lag(t) over w as pt, lag(x) over w as px from r window w as (partition by doc_id, page order by ord)),
h as (select *, rule = 'plain' and coalesce(pt like '%:', false) and x > px + 5 as hit from v)
select doc_id, ord, case when hit then 'list' when rule in ('numbered', 'lettered', 'capitals', 'size', 'bold') then 'header' when rule in ('ornament', 'plain', 'none') then 'paragraph' else rule end as type,
  case when hit then 1 when rule = 'numbered' then {P.numbered_level(DUCK, 'plain')} when rule = 'bold' then 4 when rule = 'size' then case when font_size / body >= 2 then 1 when font_size / body >= 1.75 then 2 when font_size / body >= 1.5 then 3 when font_size / body >= 1.3 then 4 when font_size / body >= 1.15 then 5 else 6 end else 0 end::integer as level from h"""
)
def classify(spark, sf_dir):
    b = blocks(spark, sf_dir)
    e = L.as_elements(b).join(L.body_font_size(b), "doc_id")
    return L.classify(e).select("doc_id", "ord", "type", "level")


@query(
    TYPED
    + f""", d as (select *, {P.numbering_depth(DUCK, 'content')} as depth, type = 'header' and bold as fits from elements),
j as (select *, fits and coalesce(lag(fits) over w and depth = lag(depth) over w and abs(y - lag(y) over w) < 24, false) as joins from d window w as (partition by doc_id, page order by ord)),
g as (select *, sum(case when joins then 0 else 1 end) over (partition by doc_id, page order by ord) as run from j), n as (select *, count(*) over (partition by doc_id, page, run) as n from g)
select doc_id, ord, case when fits and n > 1 then 'paragraph' else type end as type, case when fits and n > 1 then '**' || content || '**' else content end as content from n"""
)
def bold_runs(spark, sf_dir):
    return L.demote_bold_runs(typed(spark, sf_dir)).select("doc_id", "ord", "type", "content")


@query(
    TYPED
    + f""", d as (select *, {P.numbering_depth(DUCK, 'content')} as depth, type = 'header' and not bold and {P.numbered_header(DUCK, 'content')} as fits from elements),
j as (select *, fits and coalesce(lag(fits) over w and depth = lag(depth) over w, false) as joins, lead(type) over w as nt, lead(content) over w as nc, lead(y) over w as ny from d window w as (partition by doc_id, page order by ord)),
g as (select *, sum(case when joins then 0 else 1 end) over (partition by doc_id, page order by ord) as run from j), n as (select *, count(*) over (partition by doc_id, page, run) as n from g)
select doc_id, ord, case when fits and n > 1 then 'list' when fits and nt = 'paragraph' and regexp_matches(nc, '^\\**\\p{{Ll}}') and abs(ny - y) < 24 then 'paragraph' else type end as type,
  case when fits and n > 1 then 1 when fits and nt = 'paragraph' and regexp_matches(nc, '^\\**\\p{{Ll}}') and abs(ny - y) < 24 then 0 else level end::integer as level from n"""
)
def numbered_runs(spark, sf_dir):
    return L.demote_numbered_runs(typed(spark, sf_dir)).select("doc_id", "ord", "type", "level")


RUN = ", g as (select *, ord - row_number() over (partition by doc_id, page, type = '{kind}' order by ord) as run from elements)"


@query(TYPED + RUN.format(kind="code_block") + " select doc_id, min(ord) as ord, string_agg(content, chr(10) order by ord) as content, sum(height) as height from g where type = 'code_block' group by doc_id, page, run union all select doc_id, ord, content, height from g where type <> 'code_block'")
def code_merge(spark, sf_dir):
    return L.merge_code_blocks(typed(spark, sf_dir)).select("doc_id", "ord", "content", "height")


@query(
    TYPED.replace("1 as level", "1 as level").replace(NUMBERED.format(div="//", string="varchar"), "replace(text, ' the ', '    ')")
    + RUN.format(kind="table")
    + f""", m as (select doc_id, page, min(ord) as ord, string_agg('| ' || case when k = 1 then replace(content, '    ', ' | ') else replace(replace(content, '    ', ' | '), '   ', ' | ') end || ' |', chr(10) order by ord) as c
  from (select *, row_number() over (partition by doc_id, page, run order by ord) as k from g where type = 'table') group by doc_id, page, run),
s as (select doc_id, ord, c, len(list_filter(string_split(c, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) > 2)) = 0 as single,
  array_to_string(list_transform(string_split(c, chr(10)), lambda x: regexp_replace(regexp_replace(trim(x), '^\\| ', ''), ' \\|$', '')), chr(10)) as b from m)
select doc_id, ord, case when single then b else c end as content, case when single and {P.numbered_header(DUCK, 'b')} then 'header' when single then 'paragraph' else 'table' end as type from s
union all select doc_id, ord, content, type from g where type <> 'table'"""
)
def table_merge(spark, sf_dir):
    b = blocks(spark, sf_dir).select("doc_id", "ord", F.replace("text", F.lit(" the "), F.lit("    ")).alias("content"))
    return L.merge_table_rows(typed(spark, sf_dir).drop("content").join(b, ["doc_id", "ord"])).select("doc_id", "ord", "content", "type")


RUNNING = "select doc_id, page, {o} as ord, 'paragraph' as type, {c} as content, {y} as y from pg"


@query(
    BLOCKS
    + """, pg as (select distinct doc_id, page from blocks), e as (select doc_id, page, ord, 'paragraph' as type, text as content, y from blocks union all select doc_id, page, -1, 'paragraph', 'Annual Report ' || (page + 1), 900.0 from pg
union all select doc_id, page, 1000000, case when doc_id % 2 = 0 then 'header' else 'paragraph' end, 'Page ' || page || ' of 9', 10.0 from pg),
s as (select * from e where regexp_replace(content, '[\\s\\p{Z}\\x{85}]', '', 'g') <> ''),
x as (select doc_id, page, arg_max(ord, (y, -ord)) as t, arg_min(ord, (y, ord)) as b from s group by all),
k as (select e.*, lower(regexp_replace(content, '[\\p{Nd}\\s\\p{Z}\\x{85}]', '', 'g')) as key, ord = t or ord = b as edge from e left join x using (doc_id, page)),
c as (select doc_id, key, count(distinct page) as c from k where edge and key <> '' group by all), p as (select doc_id, count(distinct page) as p from e group by 1)
select doc_id, page, ord, content from k join p using (doc_id) left join c using (doc_id, key) where not coalesce(edge and type = 'paragraph' and c >= 3 and 3 * c >= p, false)"""
)
def running_headers(spark, sf_dir):
    b = blocks(spark, sf_dir).select("doc_id", "page", "ord", F.lit("paragraph").alias("type"), F.col("text").alias("content"), "y")
    pg = b.select("doc_id", "page").distinct()
    head = pg.select("doc_id", "page", F.lit(-1).alias("ord"), F.lit("paragraph").alias("type"), F.concat(F.lit("Annual Report "), (F.col("page") + 1).cast("string")).alias("content"), F.lit(900.0).alias("y"))
    foot = pg.select("doc_id", "page", F.lit(1000000).alias("ord"), F.when(F.col("doc_id") % 2 == 0, "header").otherwise("paragraph").alias("type"), F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" of 9")).alias("content"), F.lit(10.0).alias("y"))
    return L.drop_running_headers(b.union(head).union(foot)).select("doc_id", "page", "ord", "content")


@query(
    BLOCKS
    + f""", t as (select doc_id, page, ord, {DUCK.trim('text')} as t from blocks), k as (select *, count(*) over (partition by doc_id, t) as n, row_number() over (partition by doc_id, t order by page, ord) as k,
 t <> '' and strlen(t) < 100 and (regexp_matches(upper(t), '^(CHAPTER|SECTION|PART) ') or (t = upper(t) and strlen(t) between 6 and 59 and len(string_split(regexp_replace(t, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')) between 2 and 8)) as likely from t)
select doc_id, ord from k where not (likely and n >= 3 and k > 1)"""
)
def repeated_headers(spark, sf_dir):
    return L.drop_repeated_headers(elements_plain(spark, sf_dir)).select("doc_id", "ord")


def elements_plain(spark, sf_dir):
    return blocks(spark, sf_dir).withColumn("content", F.col("text")).withColumn("type", F.lit("paragraph"))


@query(
    BLOCKS
    + f""", e as (select doc_id, ord, case when ord % 3 = 0 then 'header' else 'paragraph' end as type, text as content, font_size, {BOLD.format(div='//')} as bold from blocks),
d as (select *, round(2 * font_size) / 2 as size, regexp_matches(content, '^[*][^*]+[*]$') as italic, {P.numbering_depth(DUCK, 'content')} as depth from e),
m as (select *, case when depth = 0 then coalesce(min(nullif(depth, 0)) over (partition by doc_id, type, size, bold, italic), 0) else depth end as dd from d)
select doc_id, ord, cast(case when type = 'header' then least(6, dense_rank() over (partition by doc_id, type order by size desc, bold desc, italic, dd)) else 0 end as integer) as level from m"""
)
def header_ranking(spark, sf_dir):
    b = blocks(spark, sf_dir)
    e = b.select("doc_id", "page", "ord", F.when(F.col("ord") % 3 == 0, "header").otherwise("paragraph").alias("type"), F.col("text").alias("content"), "font_size", F.expr(BOLD.format(div="div")).alias("bold"), F.lit(0).alias("level"))
    return L.rank_header_levels(e).select("doc_id", "ord", "level")


@query(
    BLOCKS
    + f""", e as (select doc_id, ord, case when ord = 2 and doc_id % 3 = 0 then 'Contents' when ord = 1 and doc_id % 3 = 1 then 'ABSTRACT' when ord = 7 and doc_id % 5 < 4 then 'Chapter 1' else text end as content from blocks),
t as (select doc_id, min(ord) filter (lower(trim(content)) in ('table of contents', 'contents')) as title, min(ord) filter (lower(trim(content)) = 'abstract') as abstract from e group by 1),
s as (select doc_id, title is null as own, coalesce(title, abstract + 1) as f from t),
x as (select s.*, (select min(ord) from e where e.doc_id = s.doc_id and ord >= f and upper(trim(content)) like 'CHAPTER 1%') as z, (select not regexp_matches(trim(content), '^[0-9]') from e where e.doc_id = s.doc_id and ord = f) as keep from s)
select e.doc_id, e.ord, content from e join x using (doc_id) where z is null or ord < f + case when own and keep and f < z then 1 else 0 end or ord >= z"""
)
def toc_removal(spark, sf_dir):
    content = F.when((F.col("ord") == 2) & (F.col("doc_id") % 3 == 0), "Contents").when((F.col("ord") == 1) & (F.col("doc_id") % 3 == 1), "ABSTRACT").when((F.col("ord") == 7) & (F.col("doc_id") % 5 < 4), "Chapter 1").otherwise(F.col("text"))
    return L.remove_contents(blocks(spark, sf_dir).withColumn("content", content)).select("doc_id", "ord", "content")


@query(
    BLOCKS
    + """, e as (select doc_id, ord, regexp_replace(text, '([a-z]{3})([a-z]{3})', '\\1' || chr(173) || '\\2') as content, text from blocks),
k as (select distinct doc_id, unnest(regexp_extract_all(lower(content), '\\p{L}+')) as w from e),
p as (select doc_id, ord, content, unnest(regexp_extract_all(content, '\\p{L}+(?:\\x{AD}\\p{L}+)+')) as b from e where contains(content, chr(173)))
select e.doc_id, e.ord, case when b is null then e.content when exists (select 1 from k where k.doc_id = e.doc_id and k.w = lower(replace(b, chr(173), ''))) then replace(e.content, chr(173), '') else replace(e.content, chr(173), '-') end as content from e left join p using (doc_id, ord)"""
)
def word_breaks(spark, sf_dir):
    # one break in a line: the first six letters in a row
    b = blocks(spark, sf_dir).withColumn("_a", F.regexp_extract("text", "^(.*?[a-z]{3})([a-z]{3})", 1)).withColumn("content", F.when(F.col("_a") != "", F.concat("_a", F.lit(L.SOFT), F.expr("substr(text, length(_a) + 1)"))).otherwise(F.col("text")))
    return L.resolve_word_breaks(b.drop("_a")).select("doc_id", "ord", "content")


@query(
    BLOCKS
    + """, d as (select doc_id, page, ord as d_ord, x + 5 as x1, y - 2 as y1, x + width * 0.9 as x2, y + height as y2, ((ord * 37 + doc_id) % 100) / 100.0::double as confidence, cast((ord + doc_id) % 10 as integer) as class_id from blocks),
c as (select b.doc_id, b.ord, d_ord, confidence, class_id, (least(b.x + b.width, x2) - greatest(b.x, x1)) as w, (least(b.y + b.height, y2) - greatest(b.y, y1)) as h, b.width * b.height + (x2 - x1) * (y2 - y1) as s from blocks b join d using (doc_id, page)),
v as (select *, case when w > 0 and h > 0 and s - w * h > 0 then w * h / (s - w * h) else 0 end as v from c), m as (select doc_id, ord, arg_max({'c': class_id, 'f': confidence}, (v, -d_ord)) as m from v where v > 0.3 group by all)
select b.doc_id, b.ord, cast(m.c as integer) as class_id, case when m.f >= 0.5 and m.c <> 2 then ['header', 'paragraph', '', 'figure', 'caption', 'table', 'caption', 'footnote', 'equation', 'caption'][m.c + 1] else 'paragraph' end as type from blocks b left join m using (doc_id, ord)"""
)
def detection_match(spark, sf_dir):
    b = blocks(spark, sf_dir)
    d = b.selectExpr("doc_id", "page", "ord", "x + 5 as x1", "y - 2 as y1", "x + width * 0.9D as x2", "y + height as y2", "((ord * 37 + doc_id) % 100) / 100D as confidence", "cast((ord + doc_id) % 10 as int) as class_id")
    return L.best_detections(L.as_elements(b), d).select("doc_id", "ord", "class_id", "type")
