"""Paths that share a document, page and ord are still paths of their own."""

import pytest

from folioframe.operators import tables

OPS = "doc_id int, page int, ord int, ops array<struct<op:string,points:array<struct<x:double,y:double>>>>, is_stroked boolean"


def line(x1, y1, x2, y2):
    return [("M", [(x1, y1)]), ("L", [(x2, y2)])]


@pytest.fixture
def graphics(spark):
    """A ruled grid of three by three lines, all with the same ord."""
    ruled = [line(95.0, y, 300.0, y) for y in (645.0, 690.0, 715.0)] + [line(x, 645.0, x, 715.0) for x in (95.0, 195.0, 300.0)]
    return spark.createDataFrame([(1, 0, 7, ops, True) for ops in ruled], OPS)


def test_ruled_lines(spark, graphics):
    got = {(r.x1, r.y1, r.x2, r.y2, r.kind) for r in tables.ruled_lines(graphics).collect()}
    assert got == {(95.0, y, 300.0, y, "h") for y in (645.0, 690.0, 715.0)} | {(x, 645.0, x, 715.0, "v") for x in (95.0, 195.0, 300.0)}
    closed = [("M", [(0.0, 0.0)]), ("L", [(50.0, 0.0)]), ("L", [(50.0, 50.0)]), ("Z", [])]
    twice = tables.ruled_lines(spark.createDataFrame([(1, 0, 7, closed, True)] * 2, OPS))
    assert sorted((r.nth, r.x1, r.y1, r.x2, r.y2) for r in twice.collect()) == sorted(2 * [(1, 0.0, 0.0, 50.0, 0.0), (2, 50.0, 0.0, 50.0, 50.0), (3, 50.0, 50.0, 0.0, 0.0)])


def test_grid_regions(graphics):
    (r,) = tables.grid_regions(tables.ruled_lines(graphics)).collect()
    assert (r.rows, r.cols) == ([645.0, 690.0, 715.0], [95.0, 195.0, 300.0])


def test_table_detection(spark, graphics):
    cells = [(1, 0, 2 * r + c, f"{r}{c}", 100.0 + 100 * c, 700.0 - 20 * r, 30.0, 10.0) for r in range(3) for c in range(2)]
    found, consumed = tables.detect_tables(spark.createDataFrame(cells, "doc_id int, page int, ord int, text string, x double, y double, width double, height double"), graphics)
    assert {(r.kind, r.row, r.col): r.content for r in found.collect()} == {("ruled", r, c): f"{r}{c}" for r in range(3) for c in range(2)}
    assert consumed.count() == 6


def test_region_blocks(spark, graphics):
    b = spark.createDataFrame([(1, 0, 0, 100.0, 700.0, 30.0, 10.0), (1, 0, 1, 290.0, 640.0, 10.0, 10.0), (1, 0, 2, 400.0, 700.0, 9.0, 9.0)], "doc_id int, page int, ord int, x double, y double, width double, height double")
    assert sorted(r.ord for r in tables.in_region(b, tables.grid_regions(tables.ruled_lines(graphics))).collect()) == [0, 1]


def test_separators(graphics):
    (r,) = tables.separators(graphics, 400, 600).collect()
    assert (r.horizontal, r.vertical) == ([645.0, 690.0, 715.0], [95.0, 195.0, 300.0])


def test_table_detection_brings_a_page_together_once(spark, graphics, monkeypatch):
    """One join, of pages with their grids: a sort for each join of blocks doesn't fit in memory at 36,000,000 boxes."""
    made, written = [], tables.written
    monkeypatch.setattr(tables, "written", lambda df, name: made.append(df) or written(df, name))
    spaced = [(2, 0, 10 * r + c, f"{r}{c}", 100.0 * c, 700.0 - 20 * r, 30.0, 10.0) for r in range(3) for c in range(2)]
    ruled = [(1, 0, 2 * r + c, f"{r}{c}", 100.0 + 100 * c, 700.0 - 20 * r, 30.0, 10.0) for r in range(3) for c in range(2)]
    alone = [(3, 0, 0, "few", 0.0, 0.0, 1.0, 1.0)]
    b = spark.createDataFrame(spaced + ruled + alone, "doc_id int, page int, ord int, text string, x double, y double, width double, height double")
    found, consumed = tables.detect_tables(b, graphics)
    assert sum(df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in made) == 1
    want = {(d, kind, r, c): f"{r}{c}" for d, kind in ((1, "ruled"), (2, "aligned")) for r in range(3) for c in range(2)}
    assert {(r.doc_id, r.kind, r.row, r.col): r.content for r in found.collect()} == want and consumed.count() == 12
