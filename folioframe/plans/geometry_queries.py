"""Geometry queries: tables, ruled lines, boxes and scalars, over lines of `documents` and boxes from `lineitem`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import predicates as P
from ..functions.dialect import DUCK
from ..operators import tables as T
from ..registry import query, table
from ..sources import derived

BOX = "select l_orderkey {div} 32 as doc_id, cast((l_orderkey {div} 8) % 4 as int) as page, ((l_linenumber + 10 * l_orderkey) * 10000 + l_partkey) * 100 + l_suppkey as ord, cast(l_partkey % 4 * 100 + l_partkey % 3 as double) as x, cast(l_suppkey % 8 as double) * 40 as y, l_quantity * 1.0{d} as width, 10 * (l_discount + 0.01{d}) as height, concat(l_returnflag, cast(l_linenumber as {string})) as text from "
BOXES = "with boxes as (" + BOX.format(div="//", d="::double", string="varchar") + "lineitem)"


def boxes(spark, sf_dir):
    """Boxes of eight orders a page, four pages a document: pages grow in number, not in size."""
    items = table(spark, sf_dir, "lineitem")
    return items.selectExpr(
        "l_orderkey div 32 as doc_id", "cast((l_orderkey div 8) % 4 as int) as page", "((l_linenumber + 10 * l_orderkey) * 10000 + l_partkey) * 100 + l_suppkey as ord", "cast(l_partkey % 4 * 100 + l_partkey % 3 as double) as x", "cast(l_suppkey % 8 as double) * 40 as y", "l_quantity * 1.0D as width", "10 * (l_discount + 0.01D) as height", "concat(l_returnflag, cast(l_linenumber as string)) as text"
    )


def heads_sql(items: str, tolerance: str) -> str:
    return f"list_reduce(list_transform(list_sort({items}), lambda x: [x]), lambda a, x: case when x[1] - a[-1] > {tolerance} then list_concat(a, x) else a end)"


@query(BOXES + f" select doc_id, page, array_to_string({heads_sql('list(x)', '3')}, ',') as heads from boxes group by all")
def line_cluster(spark, sf_dir):
    heads = boxes(spark, sf_dir).groupBy("doc_id", "page").agg(T.cluster_heads(F.collect_list("x")).alias("h"))
    return heads.select("doc_id", "page", F.array_join(F.transform("h", lambda x: x.cast("string")), ",").alias("heads"))


ROWS = BOXES + f", hh as (select doc_id, page, list_transform({heads_sql('list(-y)', '3')}, lambda y: -y) as h from boxes group by all), rowed as (select b.*, cast(len(list_filter(h, lambda v: v >= y)) - 1 as integer) as row from boxes b join hh using (doc_id, page))"


@query(ROWS + " select doc_id, page, ord, row from rowed")
def row_group(spark, sf_dir):
    return T.row_groups(boxes(spark, sf_dir)).select("doc_id", "page", "ord", "row")


COLUMNS = (
    ROWS
    + f""", n as (select doc_id, page, round(x / 5) * 5 as p, count(*) as n from rowed group by all), k as (select doc_id, page, max(row) + 1 as r from rowed group by all),
cols as (select doc_id, page, {heads_sql('list(p)', '10')} as columns from n join k using (doc_id, page) where n >= greatest(1, r // 2) group by all)"""
)


@query(COLUMNS + " select doc_id, page, array_to_string(columns, ',') as columns from cols")
def column_positions(spark, sf_dir):
    c = T.column_positions(T.row_groups(boxes(spark, sf_dir)))
    return c.select("doc_id", "page", F.array_join(F.transform("columns", lambda x: x.cast("string")), ",").alias("columns"))


CELLS = (
    COLUMNS
    + """, placed as (select r.*, list_position(list_transform(columns, lambda c: abs(c - x) <= 10), true) as a, list_transform(columns, lambda c: abs(c - x)) as g from rowed r join cols using (doc_id, page)),
cc as (select *, cast(case when a > 0 then a - 1 when list_min(g) <= 25 then list_position(g, list_min(g)) - 1 else -1 end as integer) as col from placed),
cells as (select doc_id, page, row, col, string_agg(text, ' ' order by x, ord, text) as content from cc where col >= 0 group by all)"""
)


@query(CELLS + " select doc_id, page, row, col, content from cells")
def table_cells(spark, sf_dir):
    return T.table_cells(boxes(spark, sf_dir))


@query(
    CELLS
    + f""", r as (select doc_id, page, row, count(*) as k, count(*) filter ({P.numeric_cell(DUCK, 'content')}) as numbers from cells group by all), s as (select doc_id, page, max(row) + 1 as n_rows, max(col) + 1 as n_cols from cells group by all)
select doc_id, page, cast(n_rows as integer) as n_rows, cast(n_cols as integer) as n_cols, round((sum(k)::double / (n_rows * n_cols) + count(*) filter (k >= n_cols // 2)::double / n_rows) / 2, 9) as confidence,
 bool_or(row = 0 and k >= n_cols // 2 and numbers = 0) and coalesce(sum(numbers) filter (row > 0), 0) > 0.3 * coalesce(sum(k) filter (row > 0), 0) as header from r join s using (doc_id, page) group by doc_id, page, n_rows, n_cols"""
)
def header_row(spark, sf_dir):
    return T.table_confidence(T.table_cells(boxes(spark, sf_dir))).withColumn("confidence", F.round("confidence", 9))


@query(
    CELLS
    + """, s as (select doc_id, page, max(row) as mr, max(col) as mc from cells group by all), g as (select doc_id, page, r.row, c.col from s, unnest(range(0, mr + 1)) as r(row), unnest(range(0, mc + 1)) as c(col)),
f as (select g.*, coalesce(content, '') as content, greatest(3, max(strlen(coalesce(content, ''))) over (partition by g.doc_id, g.page, g.col)) as w from g left join cells using (doc_id, page, row, col)),
l as (select doc_id, page, row, '| ' || string_agg(content || repeat(' ', w - strlen(content)), ' | ' order by col) || ' |' as a, '| ' || string_agg(repeat('-', w), ' | ' order by col) || ' |' as d from f group by all)
select doc_id, page, string_agg(case when row = 0 then a || chr(10) || d else a end, chr(10) order by row) as md from l group by all"""
)
def table_markdown(spark, sf_dir):
    return T.table_markdown(T.table_cells(boxes(spark, sf_dir)))


@query(BOXES + ", p as (select doc_id, page, list_sort(list(distinct x)) as ps from boxes group by all) select doc_id, page, ord, cast(greatest(0, least(len(list_filter(ps, lambda v: v <= x + width / 2)) - 1, len(ps) - 2)) as integer) as cell from boxes join p using (doc_id, page)")
def cell_assignment(spark, sf_dir):
    b = boxes(spark, sf_dir)
    p = b.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("x")).alias("ps"))
    return b.join(p, ["doc_id", "page"]).select("doc_id", "page", "ord", T.cell_of(F.col("x") + F.col("width") / 2, F.col("ps")).alias("cell"))


def graphics(spark, sf_dir):
    """Each box as a path: a rectangle, a line or a triangle by rule."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    b = boxes(spark, sf_dir)
    x, y, x2, y2 = F.col("x"), F.col("y"), F.col("x") + F.col("width") * 3, F.col("y") + F.col("height") * 60
    none = F.array().cast("array<struct<x:double,y:double>>")
    op = lambda name, *p: F.struct(F.lit(name).alias("op"), (F.array(*p) if p else none).alias("points"))
    rect = F.array(op("M", point(x, y)), op("L", point(x2, y)), op("L", point(x2, y2)), op("L", point(x, y2)), op("Z"))
    line = F.array(op("M", point(x, y)), op("L", point(x2, y + F.lit(0.2))))
    tri = F.array(op("M", point(x, y)), op("L", point(x2, y)), op("C", point(x, y), point(x2, y2), point(x, y2)), op("Z"))
    ops = F.when(F.col("ord") % 3 == 0, rect).when(F.col("ord") % 3 == 1, line).otherwise(tri)
    return b.select("doc_id", "page", "ord", "x", "y", "width", "height", ops.alias("ops"), (F.col("ord") % 4 < 3).alias("is_stroked"), (F.col("ord") % 2 == 0).alias("is_filled"))


SEGMENTS = (
    BOXES
    + """, p as (select *, x + width * 3 as x2, y + height * 60 as y2, ord % 3 as k from boxes), seg as (
select doc_id, page, ord, 1 as nth, x as ax, y as ay, x2 as bx, case when k = 1 then y + 0.2::double else y end as yb from p where ord % 4 < 3
union all select doc_id, page, ord, 2, x2, y, x2, y2 from p where ord % 4 < 3 and k = 0 union all select doc_id, page, ord, 3, x2, y2, x, y2 from p where ord % 4 < 3 and k = 0
union all select doc_id, page, ord, 4, x, y2, x, y from p where ord % 4 < 3 and k = 0 union all select doc_id, page, ord, 3, x, y2, x, y from p where ord % 4 < 3 and k = 2),
lines as (select *, case when degrees(atan2(abs(yb - ay), abs(bx - ax))) < 5 then 'h' when degrees(atan2(abs(yb - ay), abs(bx - ax))) > 85 then 'v' end as kind from seg where sqrt((bx - ax) * (bx - ax) + (yb - ay) * (yb - ay)) >= 20)"""
)


@query(SEGMENTS + " select doc_id, page, ord, nth, ax as x1, ay as y1, bx as x2, yb as y2, kind from lines")
def line_classify(spark, sf_dir):
    return T.ruled_lines(graphics(spark, sf_dir))


@query(SEGMENTS + f" select doc_id, page, array_to_string({heads_sql('list(ay) filter (kind = $$h$$)', '3')}, ',') as rows, array_to_string({heads_sql('list(ax) filter (kind = $$v$$)', '3')}, ',') as cols from lines group by all having len({heads_sql('list(ay) filter (kind = $$h$$)', '3')}) >= 2 and len({heads_sql('list(ax) filter (kind = $$v$$)', '3')}) >= 2")
def grid_regions(spark, sf_dir):
    g = T.grid_regions(T.ruled_lines(graphics(spark, sf_dir)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return g.select("doc_id", "page", text("rows"), text("cols"))


@query(SEGMENTS + " select doc_id, page, coalesce(array_to_string(list_sort(list(ay) filter (kind = 'h' and abs(bx - ax) >= 0.2 * 600)), ','), '') as horizontal, coalesce(array_to_string(list_sort(list(ax) filter (kind = 'v' and abs(yb - ay) >= 0.1 * 600)), ','), '') as vertical from lines group by all")
def separators(spark, sf_dir):
    s = T.separators(graphics(spark, sf_dir), 400, 600)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return s.select("doc_id", "page", text("horizontal"), text("vertical"))


@query(BOXES + " select doc_id, page, ord, round(x) as x1, round(y) as y1, round(x + width * 3) as x2, round(y + height * 60) as y2 from boxes where ord % 2 = 0 and ord % 3 = 0 and round(x) <> round(x + width * 3) and round(y) <> round(y + height * 60)")
def rect_cells(spark, sf_dir):
    return T.rectangle_cells(graphics(spark, sf_dir))


@query(BOXES + " select doc_id, page, ord, ord % 3 < 2 as trivial from boxes")
def trivial_graphics(spark, sf_dir):
    return graphics(spark, sf_dir).select("doc_id", "page", "ord", T.trivial_graphic(F.col("ops")).alias("trivial"))


@query(
    BOXES
    + """, f as (select *, ord % 3 as k, printf('%.2f %.2f', 5.0::double, height + 5) as p00, printf('%.2f %.2f', width * 3 + 5, height + 5) as p10, printf('%.2f %.2f', width * 3 + 5, height - height * 60 + 5) as p11, printf('%.2f %.2f', 5.0::double, height - height * 60 + 5) as p01 from boxes)
select doc_id, page, ord, case k when 0 then concat('M ', p00, ' L ', p10, ' L ', p11, ' L ', p01, ' Z') when 1 then concat('M ', p00, ' L ', printf('%.2f %.2f', width * 3 + 5, height - 0.2::double + 5)) else concat('M ', p00, ' L ', p10, ' C ', p00, ' ', p11, ' ', p01, ' Z') end as path from f"""
)
def svg_path(spark, sf_dir):
    g = graphics(spark, sf_dir)
    return g.select("doc_id", "page", "ord", B.svg_path(F.col("ops"), F.col("height"), F.col("x"), F.col("y")).alias("path"))


@query(
    BOXES
    + """, e as (select doc_id, page, ord as a, lead(ord) over o as b, x as a_x, y as a_y, x + width as a_x2, y + height as a_y2, lead(x) over o as b_x, lead(y) over o as b_y, lead(x + width) over o as b_x2, lead(y + height) over o as b_y2 from boxes window o as (partition by doc_id, page order by ord)),
p as (select doc_id, page, a, b, least(a_x2, b_x2) - greatest(a_x, b_x) as w, least(a_y2, b_y2) - greatest(a_y, b_y) as h, (a_x2 - a_x) * (a_y2 - a_y) + (b_x2 - b_x) * (b_y2 - b_y) as s, b_x between a_x and a_x2 and b_y between a_y and a_y2 as holds from e where b is not null)
select doc_id, page, a, b, round(case when w <= 0 or h <= 0 or s - w * h <= 0 then 0.0::double else w * h / (s - w * h) end, 9) as iou, w > 0 and h > 0 as overlap, holds from p"""
)
def box_predicates(spark, sf_dir):
    """Each box with the next one on its page."""
    one = boxes(spark, sf_dir).select("doc_id", "page", F.struct("ord", "x", "y", (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2")).alias("a"))
    both = one.withColumn("b", F.lead("a").over(Window.partitionBy("doc_id", "page").orderBy("a.ord"))).filter("b is not null")
    a, b = ([F.col(f"{side}.{c}") for c in ("x", "y", "x2", "y2")] for side in "ab")
    return both.select("doc_id", "page", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), F.round(B.iou(*a, *b), 9).alias("iou"), B.overlaps(*a, *b).alias("overlap"), B.contains(*a, b[0], b[1]).alias("holds"))


@query(
    "with b as (select l_orderkey, l_linenumber, cast(l_quantity * 40 as integer) as w, cast(l_partkey % 900 + 1 as integer) as h from lineitem) select l_orderkey, l_linenumber, round(least(1024.0::double / w, 1024.0::double / h), 9) as scale, cast(floor(w * least(1024.0::double / w, 1024.0::double / h)) as integer) as new_w, "
    "cast(floor((1024 - floor(w * least(1024.0::double / w, 1024.0::double / h))) / 2) as integer) as pad_x, cast(ceil(w / 32.0::double) * 32 as integer) as aligned, round(greatest(6.0::double, least(h / 0.7::double, 72.0::double)), 9) as size, round(792 - w * 0.5::double - h, 9) as flipped, "
    "cast((1 - (w % 256) / 255.0::double) * (1 - (h % 256) / 255.0::double) * 255.0::double - 0.5::double + 0.5::double as integer) - case when cast((1 - (w % 256) / 255.0::double) * (1 - (h % 256) / 255.0::double) * 255.0::double as integer) > (1 - (w % 256) / 255.0::double) * (1 - (h % 256) / 255.0::double) * 255.0::double then 1 else 0 end as red, "
    "round(greatest(0.0::double, least((w - 50) / 2.0::double, 612.0::double)), 9) as page_x from b"
)
def geometry_scalars(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_quantity * 40 as int) as w", "cast(l_partkey % 900 + 1 as int) as h")
    w, h = F.col("w"), F.col("h")
    box = B.letterbox(w.cast("double"), h.cast("double"), 1024, 1024)
    return b.select(
        "l_orderkey", "l_linenumber", F.round(box["scale"], 9).alias("scale"), box["new_w"].alias("new_w"), box["pad_x"].alias("pad_x"), B.align_up(w, 32).alias("aligned"), F.round(B.text_size(h), 9).alias("size"),
        F.round(B.flipped_y(F.lit(792), w, F.lit(0.5), h), 9).alias("flipped"), B.cmyk_to_rgb(w % 256, w, w, h % 256)[0].alias("red"), F.round(B.scaled_to_page(w.cast("double"), F.lit(2.0), F.lit(50.0), F.lit(612.0)), 9).alias("page_x"),
    )
