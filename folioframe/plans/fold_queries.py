"""Order-dependent operators on pages built so that each rule is met, with what must come out told by the page's own words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import folds, reading_order
from ..registry import query, table
from ..sources.pdf import scan
from ..sources.pdf import writer as W
from . import layout

BLANK = {"type": "paragraph", "level": 0, "x": 0.0, "width": 20.0, "height": 10.0, "font_size": 10.0, "space_width": 2.5, "bold": False, "last_y": 0.0, "link_uri": None}
FIELDS = [(f.split()[0], folds.ARROW[f.split()[1]]) for f in folds.ELEMENT.split(", ")]


def made(rows, make):
    """Elements that `make` gives for each key of rows: dictionaries of what differs from BLANK, in order."""

    def run(batches):
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                out += [BLANK | {"doc_id": key, "page": 1, "ord": i} | e for i, e in enumerate(make(key))]
            yield pa.RecordBatch.from_pylist(out, pa.schema(FIELDS))

    return rows.mapInArrow(run, folds.ELEMENT)


def on_lines(lines: list[list[dict]]) -> list[dict]:
    """Lines from the top, 20 points apart."""
    return [{"y": 700.0 - 20 * i} | e for i, line in enumerate(lines) for e in line]


LONG = "a rather long piece of text, of more than forty bytes"


def line_cases(k: int) -> list[dict]:
    w, x = f"w{k}", f"x{k}"
    raised = lambda text, at: {"content": text, "x": at, "width": 4.0, "font_size": 7.0}
    return on_lines([
        [{"content": w}, {"content": x, "x": 20.5}],
        [{"content": w}, {"content": x, "x": 25.0}],
        [{"content": w + "-"}, {"content": x, "x": 25.0}],
        [{"content": w}, {"content": x, "x": 100.0}],
        [{"content": f"${w}$"}, {"content": x, "x": 100.0}],
        [{"content": "•", "width": 4.0}, {"content": x, "x": 100.0}],
        [{"content": w}, {"content": LONG, "x": 100.0, "width": 300.0}],
        [{"content": w}, {"content": "(", "x": 100.0, "width": 3.0}, {"content": "2.1", "x": 103.0, "width": 15.0}, {"content": ")", "x": 118.0, "width": 3.0}],
        [{"content": "W", "font_size": 30.0, "y": 540.0}, {"content": "ord" + str(k), "x": 25.0, "y": 540.0}],
        [{"content": w}, raised("2", 20.0) | {"y": 523.0}],
        [raised("1", 0.0) | {"y": 503.0}, {"content": "Note" + str(k), "x": 4.0}],
        [{"content": w}, raised("2", 20.0) | {"y": 483.0}, raised("3", 24.0) | {"y": 483.0}],
        [{"content": w, "link_uri": "u"}, {"content": x, "x": 25.0, "link_uri": "u"}],
        [{"content": w, "link_uri": "u"}, {"content": x, "x": 25.0, "link_uri": "v"}],
        [{"content": w, "link_uri": "u"}, {"content": x, "x": 21.0, "link_uri": "u"}],
    ])


@query(
    f"""with k as (select p_partkey as k, 'w' || p_partkey as w, 'x' || p_partkey as x from part)
select k as p_partkey, 700.0::double - 20 * n as y, c as content, u as link_uri from k, lateral (values (0, w || x, null), (1, w || ' ' || x, null), (2, w || '-' || x, null), (3, w || '    ' || x, null), (4, '$' || w || '$   ' || x, null), (5, '• ' || x, null),
(6, w, null), (6, '{LONG}', null), (7, w || ' (2.1)', null), (8, 'Word' || k, null), (9, w || '$^{{2}}$', null), (10, '$^{{1}}$Note' || k, null), (11, w || '$^{{23}}$', null), (12, w || ' ' || x, 'u'), (13, '[' || w || '](u) [' || x || '](v)', null), (14, w || x, 'u')) as v(n, c, u)"""
)
def line_merge_rules(spark, sf_dir):
    """Gaps, bullets, long neighbours, equation numbers in pieces, drop capitals, scripts, links."""
    e = made(table(spark, sf_dir, "part").select("p_partkey"), line_cases)
    return folds.folded(e, ("doc_id", "page"), folds.merge_same_links, folds.merge_lines).select(F.col("doc_id").alias("p_partkey"), "y", "content", "link_uri")


def paragraph_cases(k: int) -> list[dict]:
    w = f"w{k}"
    first = [
        ("list", 700, f"- item {w}"), ("paragraph", 690, "goes on"), ("paragraph", 680, "and ends."),
        ("paragraph", 600, f"other {w}"), ("paragraph", 588, "line two impor-"), ("paragraph", 576, "tant words and well-"), ("paragraph", 564, "Known ones"),
        ("paragraph", 500, f"**bold {w}**"), ("paragraph", 488, "**more**"),
        ("paragraph", 400, f"Ends {w}."), ("paragraph", 384.5, "New start"), ("paragraph", 372.5, "again"),
        ("paragraph", 300, f"twice {w}"), ("paragraph", 288, f"twice {w}"),
        ("code_block", 276, "code"), ("paragraph", 264, "1. no list item yet"), ("paragraph", 252, "2. nor this"),
    ]
    second = [("paragraph", 700 - 18 * i, f"far {i} {w}") for i in range(4)] + [("paragraph", 600, "apart")]
    return [{"type": t, "y": float(y), "content": c, "page": p} for p, rows in ((1, first), (2, second)) for t, y, c in rows]


@query(
    """with k as (select s_suppkey as k, 'w' || s_suppkey as w from supplier)
select k as s_suppkey, p as page, c as content from k, lateral (values (1, '- item ' || w || ' goes on and ends.'), (1, 'other ' || w || ' line two impor' || chr(173) || 'tant words and well-Known ones'), (1, '**bold ' || w || ' more**'), (1, 'Ends ' || w || '.'), (1, 'New start again'),
(1, 'twice ' || w), (1, 'code'), (1, '1. no list item yet'), (1, '2. nor this'), (2, 'far 0 ' || w || ' far 1 ' || w || ' far 2 ' || w || ' far 3 ' || w), (2, 'apart')) as v(p, c)"""
)
def paragraph_rules(spark, sf_dir):
    """Lists that go on, hyphens at breaks, marks of style, sentence breaks, repeats, list items; and a page whose lines are far apart."""
    e = made(table(spark, sf_dir, "supplier").select("s_suppkey"), paragraph_cases)
    return folds.folded(e, ("doc_id", "page"), folds.merge_list_continuations, folds.merge_paragraphs).select(F.col("doc_id").alias("s_suppkey"), "page", "content")


@query(
    """with k as (select n_nationkey as k, 'n' || n_nationkey as w from nation)
select k as n_nationkey, cast(i as integer) as ord, c as content from k, lateral (values (0, '$' || w || '$'), (1, '$a$ $' || w || '$ b'), (2, '$a  and  ' || w || '$'), (3, '$' || w || '$ by $b$'), (4, 'one $ of ' || w), (5, '$$' || w || '$$ $$' || w || '$$'), (6, '$' || w || '  =  2$ holds'), (7, '$x$ is $' || w || '$')) as v(i, c)
where i <> 1 union all select k, 1, '$a   ' || w || '$ b' from k"""
)
def math_rules(spark, sf_dir):
    """Equal formulas side by side, doubled signs, connectives and operators between; code and lone signs stay as they are."""

    def cases(k: int) -> list[dict]:
        w = f"n{k}"
        texts = [f"${w}$ ${w}$ ${w}$", f"$a$ ${w}$ b", f"$a$ and ${w}$", f"${w}$ by $b$", f"one $ of {w}", f"$${w}$$ $${w}$$", f"${w}$ = $2$ holds", f"$x$ is ${w}$"]
        return [{"content": t, "y": 0.0, "type": "code_block" if i == 5 else "paragraph"} for i, t in enumerate(texts)]

    e = made(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k")), cases)
    return folds.math_cleaned(e).select(F.col("doc_id").cast("int").alias("n_nationkey"), "ord", "content")


BLOCK = "doc_id long, page int, ord int, text string, x double, y double, width double, height double, font_size double"


def pages_of(rows, make):
    """Blocks (text, x, y, width) of pages, in the order in which the file has them."""
    kinds = [(f.split()[0], folds.ARROW[f.split()[1]]) for f in BLOCK.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                for page, blocks in enumerate(make(key)):
                    out += [{"doc_id": key, "page": page, "ord": i, "text": t, "x": float(x), "y": float(y), "width": float(w), "height": 10.0, "font_size": 10.0} for i, (t, x, y, w) in enumerate(blocks)]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return rows.mapInArrow(run, BLOCK)


def order_cases(k: int) -> list[list[tuple]]:
    left = [(f"left {i} {k}", 50, 700 - 14 * i, 200) for i in range(4)]
    other = [(f"right {i} {k}", 320, 700 - 14 * i, 200) for i in range(4)]
    spans = [(f"title {k}", 50, 750, 470), (f"foot {k}", 50, 600, 470)]
    narrow = [(f"b {k}", 60, 702, 40), (f"a {k}", 10, 700, 40), (f"d {k}", 60, 650, 40), (f"c {k}", 10, 653, 40)]
    # capitals: nothing goes on downwards, and each left line has its neighbour, so these are rows
    rows = [(f"{c}{i} {k}", x, 700 - 14 * i, 200) for i in range(4) for c, x in (("L", 50), ("R", 320))]
    return [list(reversed(left + other)) + list(reversed(spans)), list(reversed(narrow)), list(reversed(rows)), left + other]


@query(
    """with k as (select s_suppkey as k from supplier), c as (select k, p, i, t from k, lateral (values (0, 0, 'title '), (0, 1, 'left 0 '), (0, 2, 'left 1 '), (0, 3, 'left 2 '), (0, 4, 'left 3 '), (0, 5, 'right 0 '), (0, 6, 'right 1 '), (0, 7, 'right 2 '), (0, 8, 'right 3 '), (0, 9, 'foot '),
(1, 0, 'a '), (1, 1, 'b '), (1, 2, 'c '), (1, 3, 'd '), (2, 0, 'L0 '), (2, 1, 'R0 '), (2, 2, 'L1 '), (2, 3, 'R1 '), (2, 4, 'L2 '), (2, 5, 'R2 '), (2, 6, 'L3 '), (2, 7, 'R3 '),
(3, 0, 'left 0 '), (3, 1, 'left 1 '), (3, 2, 'left 2 '), (3, 3, 'left 3 '), (3, 4, 'right 0 '), (3, 5, 'right 1 '), (3, 6, 'right 2 '), (3, 7, 'right 3 ')) as v(p, i, t))
select k as s_suppkey, cast(p as integer) as page, cast(i as integer) as ord, t || k as text from c"""
)
def column_order(spark, sf_dir):
    """Columns between a title and a foot, from a file that goes upwards; bands of a narrow page; rows; a coherent file."""
    b = pages_of(table(spark, sf_dir, "supplier").select("s_suppkey"), order_cases)
    return reading_order.reading_order(b).select(F.col("doc_id").alias("s_suppkey"), "page", "ord", "text")


@query(
    """with n as (select n_nationkey, lower(n_name) as n, n_regionkey as r from nation)
select n_nationkey, '# Report on ' || n || chr(10) || chr(10) || 'This report is about ' || n || ' and its people, who live in many towns. It has two short parts.' || chr(10) || chr(10) || '## Results' || chr(10) || chr(10) || 'Region ' || r || ' grew steadily over all the quarters of the year.' || chr(10) || chr(10)
 || '- Apples of ' || n || chr(10) || '- Bread.' || chr(10) || chr(10) || 'The second page goes on about ' || n || ' at some length.' || chr(10) || chr(10) as md from n"""
)
def pdf_report(spark, sf_dir):
    """From bytes to Markdown over two pages: headings by size, joined lines, a list, a paragraph."""

    def make(batches):
        for batch in batches:
            out = []
            for name, region in zip(batch.column("n").to_pylist(), batch.column("r").to_pylist()):
                one = [("Helvetica-Bold", 24, 72, 740, f"Report on {name}"), ("Helvetica", 12, 72, 700, f"This report is about {name} and its people, who live in many towns."), ("Helvetica", 12, 72, 686, "It has two short parts."), ("Helvetica-Bold", 16, 72, 640, "Results"), ("Helvetica", 12, 72, 615, f"Region {region} grew steadily over all the quarters of the year."), ("Helvetica", 12, 72, 580, f"• Apples of {name}"), ("Helvetica", 12, 72, 566, "• Bread.")]
                out.append(W.write([one, [("Helvetica", 12, 72, 740, f"The second page goes on about {name} at some length.")]]))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    rows = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as long) as path", "lower(n_name) as n", "n_regionkey as r")
    pages = scan.scan(rows.mapInArrow(make, "path long, content binary"))
    return layout.to_markdown(scan.part(pages, "blocks"), links=scan.part(pages, "links")).select(F.col("doc_id").cast("int").alias("n_nationkey"), "md")
