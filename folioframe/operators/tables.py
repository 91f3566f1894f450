"""Table geometry: rows, columns, cells and ruled lines of a page, as native expressions keyed by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import predicates as P
from ..functions.dialect import SPARK
from ..storage import written

PAGE = ("doc_id", "page")


def cluster_heads(positions: Column, tolerance: float = 3.0) -> Column:
    """From sorted positions those that lie over `tolerance` from the last one kept."""
    empty = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(positions), empty, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > tolerance), F.array_append(acc, x)).otherwise(acc))


def row_groups(blocks: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """blocks with row: from the top, a new row where y lies over `tolerance` from the row's first; row 0 is the top."""
    heads = blocks.groupBy(*PAGE).agg(F.transform(cluster_heads(F.transform(F.collect_set("y"), lambda y: -y), tolerance), lambda y: -y).alias("_heads"))
    # the heads fall; a block belongs to the last one not below it
    return blocks.join(heads, [*PAGE]).withColumn("row", F.size(F.filter("_heads", lambda h: h >= F.col("y"))) - 1).drop("_heads")


def column_positions(rowed: DataFrame, grid: float = 5.0, merge: float = 10.0) -> DataFrame:
    """doc_id, page, columns: rounded x that occur in half of the rows at least, those within `merge` of the last kept left out."""
    rows = rowed.groupBy(*PAGE).agg((F.max("row") + 1).alias("_rows"))
    n = rowed.groupBy(*PAGE, (F.round(F.col("x") / grid) * grid).alias("p")).agg(F.count("*").alias("n"))
    often = n.join(rows, [*PAGE]).filter("n >= greatest(1, _rows div 2)")
    return often.groupBy(*PAGE).agg(cluster_heads(F.collect_list("p"), merge).alias("columns"))


def nearest_column(x: Column, columns: Column, near: float = 10.0, far: float = 25.0) -> Column:
    """0-based: the first within near, else the nearest within far, else -1."""
    first = F.array_position(F.transform(columns, lambda c: F.abs(c - x) <= near), True) - 1
    gaps = F.transform(columns, lambda c: F.abs(c - x))
    best = F.when(F.array_min(gaps) <= far, F.array_position(gaps, F.array_min(gaps)) - 1).otherwise(-1)
    return F.when(first >= 0, first).otherwise(F.coalesce(best, F.lit(-1))).cast("int")


def cell_of(centre: Column, positions: Column) -> Column:
    """The interval [p_i, p_i+1) that a centre lies in; below the first is 0, beyond the last the last."""
    return F.greatest(F.lit(0), F.least(F.size(F.filter(positions, lambda p: p <= centre)) - 1, F.size(positions) - 2)).cast("int")


def table_cells(blocks: DataFrame) -> DataFrame:
    """doc_id, page, row, col, content: texts of a cell from left to right."""
    rowed = row_groups(blocks)
    placed = rowed.join(column_positions(rowed), [*PAGE]).withColumn("col", nearest_column(F.col("x"), F.col("columns"))).filter("col >= 0")
    return cell_texts(placed)


def cell_texts(placed: DataFrame, *more: str) -> DataFrame:
    """doc_id, page, more, row, col, content: the texts of each cell's blocks, left to right."""
    return placed.groupBy(*PAGE, *more, "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "ord", "text"))), lambda s: s["text"]), " ").alias("content"))


def table_confidence(cells: DataFrame) -> DataFrame:
    """doc_id, page, n_rows, n_cols, confidence (mean of coverage and of the share of rows at least half full), header."""
    numeric = F.expr(P.numeric_cell(SPARK, "content"))
    r = cells.groupBy(*PAGE, "row").agg(F.count("*").alias("k"), F.sum(numeric.cast("int")).alias("numbers"))
    size = cells.groupBy(*PAGE).agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    both = r.join(size, [*PAGE])
    full = F.when(F.col("k") >= F.floor(F.col("n_cols") / 2), 1).otherwise(0)
    first = F.max(F.when((F.col("row") == 0) & (F.col("k") >= F.floor(F.col("n_cols") / 2)) & (F.col("numbers") == 0), 1).otherwise(0)) == 1
    others = F.sum(F.when(F.col("row") > 0, F.col("numbers")).otherwise(0)) > 0.3 * F.sum(F.when(F.col("row") > 0, F.col("k")).otherwise(0))
    return both.groupBy(*PAGE, "n_rows", "n_cols").agg(((F.sum("k") / (F.col("n_rows") * F.col("n_cols")) + F.sum(full) / F.col("n_rows")) / 2).alias("confidence"), (first & others).alias("header"))


def table_markdown(cells: DataFrame) -> DataFrame:
    """doc_id, page, md: columns padded to their widest cell, a rule after the first row."""
    size = cells.groupBy(*PAGE).agg(F.max("row").alias("_r"), F.max("col").alias("_c"))
    grid = size.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("_r")))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("_c")))).drop("_r", "_c")
    full = grid.join(cells, [*PAGE, "row", "col"], "left").withColumn("content", F.coalesce("content", F.lit("")))
    full = full.withColumn("_w", F.greatest(F.lit(3), F.max(F.octet_length("content")).over(Window.partitionBy(*PAGE, "col"))))
    padded = F.concat("content", F.expr("repeat(' ', _w - octet_length(content))"))
    line = lambda c: F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", c.alias("v")))), lambda s: s["v"]), " | "), F.lit(" |"))
    rows = full.groupBy(*PAGE, "row").agg(line(padded).alias("a"), line(F.expr("repeat('-', cast(_w as int))")).alias("rule"))
    text = F.when(F.col("row") == 0, F.concat("a", F.lit("\n"), "rule")).otherwise(F.col("a"))
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", text.alias("t")))), lambda s: s["t"]), "\n").alias("md"))


def ruled_lines(graphics: DataFrame, least: float = 20.0, angle: float = 5.0) -> DataFrame:
    """doc_id, page, ord, nth, x1, y1, x2, y2, kind: segments of stroked paths that are long enough; kind h, v or null. ops: array of struct op, points."""
    # each op with the point before it, put together in the row: paths are told apart also where they share an ord
    end = F.transform("ops", lambda o: F.when(o["op"] == "Z", F.expr("ops[0].points[0]")).otherwise(F.element_at(o["points"], -1)))
    steps = F.transform(F.col("_ends"), lambda e, i: F.struct(F.get("ops", i)["op"].alias("op"), F.get("_ends", i - 1).alias("from"), e.alias("end")))
    ops = graphics.filter("is_stroked").select(*PAGE, "ord", "ops", end.alias("_ends")).select(*PAGE, "ord", F.posexplode(steps).alias("nth", "o"))
    s = ops.select(*PAGE, "ord", "nth", "o.op", F.col("o.from").alias("_from"), F.col("o.end").alias("_end")).filter("op in ('L', 'Z') and _from is not null")
    s = s.select(*PAGE, "ord", "nth", F.col("_from.x").alias("x1"), F.col("_from.y").alias("y1"), F.col("_end.x").alias("x2"), F.col("_end.y").alias("y2"))
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    slope = F.degrees(F.atan2(dy, dx))
    return s.filter(F.sqrt(dx * dx + dy * dy) >= least).withColumn("kind", F.when(slope < angle, "h").when(slope > 90 - angle, "v"))


def grid_regions(lines: DataFrame) -> DataFrame:
    """doc_id, page, rows, cols (clustered positions) where at least two lines run each way."""
    at = lambda kind, col: cluster_heads(F.collect_list(F.when(F.col("kind") == kind, F.col(col))))
    return lines.groupBy(*PAGE).agg(at("h", "y1").alias("rows"), at("v", "x1").alias("cols")).filter((F.size("rows") >= 2) & (F.size("cols") >= 2))


def separators(graphics: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """doc_id, page, horizontal, vertical: positions of ruled lines that span a good part of the page, sorted."""
    lines = ruled_lines(graphics)
    h = F.when((F.col("kind") == "h") & (F.abs(F.col("x2") - F.col("x1")) >= 0.3 * page_width), F.col("y1"))
    v = F.when((F.col("kind") == "v") & (F.abs(F.col("y2") - F.col("y1")) >= 0.1 * page_height), F.col("x1"))
    return lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(h)).alias("horizontal"), F.array_sort(F.collect_list(v)).alias("vertical"))


def rectangle_cells(graphics: DataFrame) -> DataFrame:
    """doc_id, page, ord, x1, y1, x2, y2 of filled paths whose first four points are a rectangle's corners."""
    pts = F.slice(F.flatten(F.transform(F.filter("ops", lambda o: o["op"].isin("M", "L")), lambda o: o["points"])), 1, 4)
    g = graphics.filter("is_filled").withColumn("_p", pts).filter(F.size("_p") == 4)
    xs, ys = F.transform("_p", lambda p: F.round(p["x"])), F.transform("_p", lambda p: F.round(p["y"]))
    two = (F.size(F.array_distinct(xs)) == 2) & (F.size(F.array_distinct(ys)) == 2)
    return g.filter(two).select(*PAGE, "ord", F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def trivial_graphic(ops: Column, tolerance: float = 0.5) -> Column:
    """No ops, a single line, or an axis-aligned rectangle."""
    kinds = F.array_join(F.transform(ops, lambda o: o["op"]), "")
    ends = F.transform(F.filter(ops, lambda o: o["op"] != "Z"), lambda o: F.element_at(o["points"], -1))
    edges = F.zip_with(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(0))), lambda a, b: (F.abs(a["x"] - b["x"]) <= tolerance) | (F.abs(a["y"] - b["y"]) <= tolerance))
    return (F.size(ops) == 0) | F.regexp_like(kinds, F.lit("^ML(LZ?)?$")) | F.regexp_like(kinds, F.lit("^ML{3,4}Z?$")) & F.forall(edges, lambda e: e)


def in_region(blocks: DataFrame, regions: DataFrame, slack: float = 5.0) -> DataFrame:
    """blocks whose centre lies in a grid region of their page, give or take `slack`."""
    r = regions.select(*PAGE, F.array_min("rows").alias("_y1"), F.array_max("rows").alias("_y2"), F.array_min("cols").alias("_x1"), F.array_max("cols").alias("_x2"))
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    return blocks.join(r, [*PAGE]).filter(cx.between(F.col("_x1") - slack, F.col("_x2") + slack) & cy.between(F.col("_y1") - slack, F.col("_y2") + slack)).drop("_y1", "_y2", "_x1", "_x2")


def ruled_column(x: Column, edges: Column, slack: float = 5.0) -> Column:
    """0-based: the first interval between neighbouring edges that x lies in, give or take `slack`, else -1."""
    fits = F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda left, i: (x >= left - slack) & (x < F.get(edges, i + 1) + slack))
    return (F.array_position(fits, F.lit(True)) - 1).cast("int")


def often(values: Column, least: Column) -> Column:
    """Of a sorted array the values that occur so many times at least, each once."""
    return F.array_distinct(F.filter(values, lambda v, i: F.get(values, i + least.cast("int") - 1) == v))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row: those of a generator are not put into the expressions that read them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def placed_blocks(blocks: DataFrame, graphics: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, page, kind, ord, row, col, x, text of the blocks that tables consume (col -1: in no column).

    A page's blocks are brought together once, in an array; all that is decided page by page is worked out there.
    """
    each = lambda name, f: F.transform(name, lambda b: b[f])
    heads = lambda ys: F.transform(cluster_heads(F.transform(F.array_distinct(ys), lambda y: -y), config.row_tolerance), lambda y: -y)
    row = lambda b: F.size(F.filter("_heads", lambda h: h >= b["y"])) - 1
    cell = lambda b, col: F.struct(b["ord"].alias("ord"), row(b).alias("row"), col.alias("col"), b["x"].alias("x"), b["text"].alias("text"))
    least, slack = config.min_table_rows * config.min_table_columns, 5.0
    grids = grid_regions(ruled_lines(graphics)).filter(F.size("cols") > config.min_table_columns)
    grids = grids.select(*PAGE, "cols", F.array_min("rows").alias("_y1"), F.array_max("rows").alias("_y2"), F.array_min("cols").alias("_x1"), F.array_max("cols").alias("_x2"))
    p = blocks.filter("doc_id is not null and page is not null").groupBy(*PAGE).agg(F.collect_list(F.struct("ord", "x", "y", "width", "height", "text")).alias("_all")).filter(F.size("_all") >= least)
    p = p.join(grids, [*PAGE], "left")
    held = lambda b: (b["x"] + b["width"] / 2).between(F.col("_x1") - slack, F.col("_x2") + slack) & (b["y"] + b["height"] / 2).between(F.col("_y1") - slack, F.col("_y2") + slack)
    p = once(p, _in=F.when(F.col("cols").isNotNull(), F.filter("_all", held)))
    p = once(p, _h=F.when(F.size("_in") >= least, heads(each("_in", "y"))))
    ruled = F.coalesce(F.size("_h") >= config.min_table_rows, F.lit(False))
    p = once(p, _ruled=ruled, _use=F.when(ruled, F.col("_in")).otherwise(F.col("_all")), _heads=F.when(ruled, F.col("_h")).otherwise(heads(each("_all", "y"))), _at=F.when(~ruled, F.array_sort(F.transform("_all", lambda b: F.round(b["x"] / 5.0) * 5.0))))
    p = once(p.select(*PAGE, "_ruled", "_use", "_heads", "_at", "cols"), _cols=F.when(F.col("_ruled"), F.col("cols")).otherwise(cluster_heads(often(F.col("_at"), F.greatest(F.lit(1), F.floor(F.size("_heads") / 2))), 10.0)))
    aligned = F.filter(F.transform("_use", lambda b: cell(b, nearest_column(b["x"], F.col("_cols")))), lambda c: c["col"] >= 0)
    p = once(p, _cells=F.when(F.col("_ruled"), F.transform("_use", lambda b: cell(b, ruled_column(b["x"], F.col("_cols"), config.column_tolerance)))).otherwise(aligned)).select(*PAGE, "_ruled", "_cells")
    # the confidence of table_confidence, from the cells that have blocks
    taken = F.array_sort(F.transform(F.array_distinct(F.transform("_cells", lambda c: c["row"].cast("long") * (1 << 31) + c["col"])), lambda k: F.floor(k / (1 << 31))))
    p = once(p, _rows=F.when(~F.col("_ruled"), taken), _n=F.array_max(each("_cells", "row")) + 1, _m=F.array_max(each("_cells", "col")) + 1)
    full = F.size(often(F.col("_rows"), F.greatest(F.lit(1), F.floor(F.col("_m") / 2))))
    sure = (F.size("_rows") / (F.col("_n") * F.col("_m")) + full / F.col("_n")) / 2 >= config.min_table_confidence
    p = p.filter(F.col("_ruled") | (F.col("_n") >= config.min_table_rows) & (F.col("_m") >= config.min_table_columns) & sure)
    return p.select(*PAGE, F.when(F.col("_ruled"), "ruled").otherwise("aligned").alias("kind"), F.inline("_cells"))


def detect_tables(blocks: DataFrame, graphics: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Cells (doc_id, page, kind, row, col, content) and the blocks they consume (doc_id, page, ord); at most one table a page.

    A ruled grid (kind ruled) comes first; pages without one may have a table by their blocks' positions (kind aligned), if its
    confidence is high enough. Pages with fewer than rows x columns blocks have none.
    """
    both = written(placed_blocks(blocks, graphics, config), "tables-placed")  # read twice, made once
    return cell_texts(both.filter("col >= 0"), "kind"), both.select(*PAGE, "ord")


def unconsumed(blocks: DataFrame, consumed: DataFrame) -> DataFrame:
    """The blocks that no table has."""
    return blocks.join(consumed, [*PAGE, "ord"], "left_anti")
