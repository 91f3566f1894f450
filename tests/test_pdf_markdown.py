"""pdf_markdown over many files: each is read once, and what is done for one page or one number at a time stays cheap."""

import os
import random

import pyarrow as pa
import pytest

from folioframe.functions.dialect import SPARK, Engine
from folioframe.operators import folds
from folioframe.plans import layout
from folioframe.sources.pdf import fonts, scan
from folioframe.sources.pdf.objects import Lexer
from folioframe.sources.pdf.writer import write


def test_each_file_is_read_once(spark, tmp_path):
    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(f"{tmp_path}/{path}", "a") as f:
                    f.write(".")
            data = [write([[("Helvetica", 10, 72, 700, f"Text of file {p}."), ("Helvetica", 10, 72, 688, "More of it.")]]) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["path", "content"])

    files = spark.range(4).toDF("path").mapInArrow(read, "path long, content binary")
    got = layout.to_markdown(scan.part(scan.scan(files), "blocks")).collect()
    assert {r.doc_id: r.md for r in got} == {i: f"Text of file {i}. More of it.\n\n" for i in range(4)}
    assert [os.path.getsize(f"{tmp_path}/{i}") for i in range(4)] == [1] * 4


def test_groups_are_folded_many_at_a_time(spark):
    r = random.Random(4)
    blank = {"type": "paragraph", "level": 0, "x": 0.0, "y": 0.0, "width": 20.0, "height": 10.0, "font_size": 10.0, "space_width": 2.5, "bold": False, "last_y": 0.0, "link_uri": None}
    rows = [blank | {"doc_id": d, "page": p, "ord": i, "content": f"{d} {p} {i}"} for d in (None, "", "a", "b") for p in range(3) for i in range(r.randrange(1, 9))]
    before, shuffled = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), rows[:]
    r.shuffle(shuffled)
    joined = lambda e: [e[0] | {"content": "|".join(x["content"] for x in e)}]
    df = spark.createDataFrame([tuple(x[f] for f in folds.FIELDS) for x in shuffled], folds.ELEMENT.replace("doc_id long", "doc_id string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # groups go over several batches
    try:
        for keys in (("doc_id", "page"), ("doc_id",)):
            want = {}
            for x in rows:
                want.setdefault(tuple(x[k] for k in keys), []).append(x["content"])
            out = folds.folded(df, keys, joined)
            assert {tuple(x[k] for k in keys): x.content for x in out.collect()} == {k: "|".join(v) for k, v in want.items()}
            assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # before: a call, and an Arrow stream, for each page
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_trim_takes_what_the_pattern_takes(spark):
    rows = [(chr(c),) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + [("",), (" \n",), (None,), ("  \r\n",)]
    df = spark.createDataFrame(rows, "c string").selectExpr("c", "concat(c, ' a', c, 'b ', c) as t")
    pattern = lambda x: SPARK.sub(x, f"^{Engine.blank}+|{Engine.blank}+$", "")
    assert df.filter(" or ".join(f"not ({SPARK.trim(x)} <=> {pattern(x)})" for x in ("c", "t"))).count() == 0
    assert "regexp" not in SPARK.trim("t")  # before: a pattern tried at each character


@pytest.mark.parametrize("text", [b"1 2 3]", b"]", b" \n1.5 -2\t00 ]", b"1 0 R 2]", b"1 [2 3] /a]", b"+1 .5 5. 1e3]", b"1 % remark ]\n2]", b"1(a)2]", b"--1 1-2 1_0]", b"9" * 30 + b"]"])
def test_arrays_of_plain_numbers_are_read_as_others(text):
    quick, slow = Lexer(b"[" + text + b" 7 "), Lexer(b"[%\n" + text + b" 7 ")  # a remark is no plain number
    a, b = quick.object(), slow.object()
    assert a == b and list(map(type, a)) == list(map(type, b)) and quick.token() == slow.token() == 7


def test_equal_fonts_of_many_files_are_made_once(monkeypatch):
    made = []
    plain = fonts.Font.__init__
    monkeypatch.setattr(fonts.Font, "__init__", lambda self, *a: made.append(a[2]) or plain(self, *a))
    getattr(fonts, "KNOWN", {}).clear()
    pages = [next(scan.page_content(write([[("Helvetica", 10, 72, 700, f"n {i}"), ("Courier", 10, 72, 688, "x")]]))) for i in range(5)]
    assert [b["text"] for p in pages for b in p["blocks"]] == [t for i in range(5) for t in (f"n {i}", "x")]
    assert sorted(made) == ["F1", "F2", "F3"]  # before: fifteen
