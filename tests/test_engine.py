"""Known cases of the layout, scoring, vision and page-scan operators."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.functions import edits
from folioframe.functions import markdown as M
from folioframe.functions import predicates as P
from folioframe.functions.dialect import SPARK
from folioframe.operators import folds, layout, reading_order, scoring, tables, vision
from folioframe.plans import layout as plan
from folioframe.sources.pdf import crypt, filters, scan
from folioframe.sources.pdf.interpreter import Interpreter
from folioframe.sources.pdf.writer import write


def element(content, x=0.0, y=0.0, width=0.0, size=10.0, kind="paragraph", **more):
    return {"doc_id": 1, "page": 0, "ord": 0, "type": kind, "content": content, "level": 0, "x": float(x), "y": float(y), "width": float(width), "height": float(size), "font_size": float(size), "space_width": 0.0, "bold": False, "last_y": 0.0, "link_uri": None} | more


def frame(spark, rows):
    return spark.createDataFrame([tuple((r | {"ord": i})[f] for f in folds.FIELDS) for i, r in enumerate(rows)], folds.ELEMENT)


PREDICATES = {
    "list_item": (["- Item", "**- Item**", "*• Item*", "1. Item", "**1. Item**", "[12] x"], ["Regular text", "**Regular**", "* item", "10. x"]),
    "code_line": (["func main() {", "if (x > 0) {", "],", "{", "() [] {}"], ["$n$", "(1)x", "{a, b}", "f(x) = { x if x > 0; 0 otherwise }", "if this then"]),
    "table_row": (["Name    Value    Description", "Total    100    200    300"], ["plain text"]),
    "numeric_cell": (["123", "45.67", "$100", "50%", "-42"], ["Hello", "ABC123", ""]),
    "numbered_header": (["1. Introduction", "3.1.4. Foo", "IV. Results", "2.1 Data"], ["1 Intro", "1. This is a long sentence that will go on and on.", "x. y", "1."]),
    "caps_heading": (["REFERENCES", "RELATED WORK"], ["TABLE II", "AB C", "References"]),
    "page_number": (["12", "- 3 -", "— 12 —"], ["1234", "a", "12 a"]),
    "admonition": (["NOTE x", "**WARNING** y", "NOTEBOOK"], ["a NOTE"]),
}


@pytest.mark.parametrize("name", PREDICATES)
def test_predicates(spark, name):
    yes, no = PREDICATES[name]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string").select("t", F.expr(getattr(P, name)(SPARK, "t")).alias("v")).collect()
    assert {r.t for r in rows if r.v} == set(yes)


def test_line_merging():
    hello = [element("Hello", 10, 100, 40, 12), element("World", 60, 100.5, 40, 12), element("Next", 10, 150, 40, 12)]
    assert [e["content"] for e in folds.merge_lines(hello)] == ["Hello World", "Next"]
    near = [element("or", 0, 0, 10), element("ENV", 12, 0, 15)]
    assert folds.merge_lines(near)[0]["content"] == "or ENV"
    near[1]["x"] = 10.5
    assert folds.merge_lines(near)[0]["content"] == "orENV"
    k = [element("= 10", 460.9, 204.2, 22.9, 10.9), element("9", 483.8, 208.1, 4, 8), element("K.", 492.5, 204.2, 10, 10.9)]
    assert folds.merge_lines(k)[0]["content"] == "= 10$^{9}$ K."
    note = [element("1", 10, 103, 3, 7), element("Footnote text", 14, 100, 60, 10)]
    assert folds.merge_lines(note)[0]["content"] == "$^{1}$Footnote text"


def test_wrapping_and_math():
    assert folds.wrapped("it is impor-", "tant to") == "it is impor­tant to"
    assert folds.wrapped("the input-", "Output pairs") == "the input-Output pairs"
    assert folds.wrapped("**bold line**", "**next line**") == "**bold line next line**"
    assert [folds.cleaned_math(t) for t in ("$n$ $n$", "$x$ $x$ $x$", "$n$ $m$", "$n$$n$")] == ["$n$", "$x$", "$n$ $m$", "$n$"]


def test_paragraphs_and_lists():
    lines = [element("One line", y=100), element("goes on.", y=88), element("New.", y=40)]
    assert [e["content"] for e in folds.merge_paragraphs(lines)] == ["One line goes on.", "New."]
    items = [element("- an item that", kind="list"), element("goes on."), element("Other text that stays.")]
    assert [e["content"] for e in folds.merge_list_continuations(items)] == ["- an item that goes on.", "Other text that stays."]


def test_reading_order():
    block = lambda x, y, text="t": {"x": x, "y": y, "width": 200.0, "height": 10.0, "font_size": 10.0, "text": text}
    two = [block(50.0, 700.0 - 12 * i) for i in range(5)] + [block(300.0, 700.0 - 12 * i) for i in range(5)]
    assert reading_order.coherent(two) and reading_order.order(two) == two
    mixed = [two[5 * (i % 2) + i // 2] for i in range(10)][::-1]
    assert [b["x"] for b in reading_order.by_columns(mixed)] == [50.0] * 5 + [300.0] * 5
    up = [block(0.0, float(y)) for y in (100, 200, 300)]
    assert [b["y"] for b in reading_order.order(up)] == [300, 200, 100]


def test_body_size(spark):
    rows = [(1, 10.0, "a" * 80), (1, 10.0, "a" * 80), (1, 8.0, "b"), (2, 12.0, "abcd"), (2, 10.0, "wxyz"), (3, 0.0, "x")]
    got = layout.body_font_size(spark.createDataFrame(rows, "doc_id int, font_size double, text string")).collect()
    assert {r.doc_id: r.body for r in got} == {1: 10.0, 2: 10.0, 3: 0.0}


def test_header_levels(spark):
    rows = [element("a", size=24, kind="header"), element("b", size=16, kind="header"), element("c", size=16, kind="header"), element("d", size=12, kind="header", bold=True)]
    assert [r.level for r in layout.rank_header_levels(frame(spark, rows)).orderBy("ord").collect()] == [1, 2, 2, 3]
    rows = [element(t, size=12, kind="header") for t in ("1 a", "1.1 b", "1.1.1 c", "2 d")]
    assert [r.level for r in layout.rank_header_levels(frame(spark, rows)).orderBy("ord").collect()] == [1, 2, 3, 1]


def test_running_headers(spark):
    rows = [r | {"page": p} for p in range(4) for r in (element("3D ERT A PREPRINT", y=800), element(f"body {'x' * p}", y=400), element(f"Page {p} of 4", y=10))]
    kept = [r.content for r in layout.drop_running_headers(frame(spark, rows)).orderBy("page").collect()]
    assert kept == ["body ", "body x", "body xx", "body xxx"]


def test_contents(spark):
    rows = [element(t) for t in ("Title", "Table of Contents", "1. Intro", "2. Body", "CHAPTER 1", "text")]
    assert [r.content for r in layout.remove_contents(frame(spark, rows)).orderBy("ord").collect()] == ["Title", "CHAPTER 1", "text"]


def test_word_breaks(spark):
    rows = [element("It is impor­tant and well­studied."), element("Important results.")]
    assert layout.resolve_word_breaks(frame(spark, rows)).orderBy("ord").first().content == "It is important and well-studied."


def test_scores(spark):
    p = spark.createDataFrame([("1", "the cat the", "the cat"), ("2", "", "x"), ("3", "A-b", "a b")], "file string, gen string, gt string")
    assert {r.file: round(r.word_f1, 6) for r in scoring.word_f1(p).collect()} == {"1": 0.8, "2": 0.0, "3": 1.0}
    h = spark.createDataFrame([("1", "# A\n# B", "# A\n## B"), ("2", "## [Docs](x)", "## Docs"), ("3", "", ""), ("4", "text", "# A")], "file string, gen string, gt string")
    assert {r.file: r.heading_f1 for r in scoring.heading_f1(h).collect()} == {"1": 0.5, "2": 1.0, "3": 1.0, "4": 0.0}
    assert {r.file: r.heading_text_f1 for r in scoring.heading_f1(h, False).collect()}["1"] == 1.0
    s = spark.createDataFrame([("1", "The result of informa tion retrieval\nis theresult here.", "The result of information retrieval is here.")], "file string, gen string, gt string")
    assert tuple(scoring.spacing_errors(s).first())[1:] == (1, 1)
    base = spark.createDataFrame([("a", 0.8), ("b", 0.7), ("c", 0.6)], "file string, score double")
    got = spark.createDataFrame([("a", 0.79), ("b", 0.6), ("d", 0.1)], "file string, score double")
    assert sorted(r.file for r in scoring.regressions(base, got).collect()) == ["b", "c"]


def test_baseline_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "file string, score double")
    scoring.write_baseline(rows, f"{tmp_path}/b", "set", "tool")
    assert {(r.file, r.score) for r in scoring.read_baseline(spark, f"{tmp_path}/b").collect()} == {("a", 0.5), ("b", 0.25)}
    with pytest.raises(ValueError):
        scoring.write_baseline(rows.limit(0), f"{tmp_path}/c", "set", "tool")


def test_markdown(spark):
    rows = [element("Title", kind="header", level=2), element("• item", kind="list", level=1), element("1. step", kind="list", level=2), element("a | b\nc | d", kind="table"), element("NOTE look", kind="admonition"), element("x=1", kind="code_block"), element("p.png", kind="image")]
    assert M.build(frame(spark, rows)).first().md == "## Title\n\n- item\n  1. step\n\n| a | b |\n| --- |\n| c | d |\n\n> **NOTE** look\n\n```\nx=1\n```\n\n![Image](p.png)\n\n"


def test_filters():
    assert filters.ascii_hex(b"48656C6C6F3>") == b"Hello0" and filters.ascii_hex(b">") == b""
    assert filters.lzw(bytes.fromhex("800B6050220C0C8501")) == b"-----A---B"
    assert filters.run_length(b"\x02abc\xfex\x80") == b"abcxxx"
    for bad in (lambda: filters.ascii_hex(b"48GG>"), lambda: filters.decode(b"x", ["FlateDecode"]), lambda: filters.unpredicted(b"x" * 9, 263, -38), lambda: filters.run_length(b"\x05a"), lambda: filters.decode(b"", ["JBIG2Decode"])):
        with pytest.raises(filters.FilterError):
            bad()
    import zlib

    with pytest.raises(filters.FilterError):
        filters.flate(zlib.compress(bytes(1000)), cap=999)
    rows = b"\x01" + bytes([1] * 3) + b"\x02" + bytes([1] * 3)
    assert filters.unpredicted(rows, 12, 3) == bytes([1, 2, 3, 2, 3, 4])


def test_ciphers():
    keys = crypt.schedule(bytes(range(16)))
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt.encrypt_block(keys, plain).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a" and crypt.decrypt_block(keys, crypt.encrypt_block(keys, plain)) == plain
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert crypt.cbc_decrypt(bytes(32), crypt.cbc_encrypt(bytes(32), plain, bytes(16)), bytes(16), padded=False) == plain


class Plain:
    cache: dict = {}

    def get(self, x):
        return x

    def decoded(self, s):
        return s.raw


def blocks(content):
    Plain.cache = {}
    run = Interpreter(Plain(), {"Font": {"F1": {"Subtype": "Type1", "BaseFont": "X", "FirstChar": 32, "Widths": [250] + [500] * 223}}})
    run.run(content)
    return run.blocks


def test_text_showing():
    a, b = blocks(b"BT /F1 10 Tf 2 Tc 50 Tz 100 200 Td (AB) Tj (C) Tj ET")
    assert (a["width"], b["x"]) == (7.0, 107.0)
    assert blocks(b"BT /F1 10 Tf 3 Tw 0 0 Td (A A) Tj (B) Tj ET")[1]["x"] == 15.5
    assert blocks(b"BT /F1 10 Tf 0 0 Td [(A) -1000 (B)] TJ (C) Tj ET")[1]["x"] == 20.0
    assert [b["text"] for b in blocks(b"BT /F1 10 Tf [(A) -199 (B)] TJ [(A) -48 (B)] TJ [(A ) -1000 (B)] TJ ET")] == ["A B", "AB", "A B"]
    assert blocks(b"2 0 0 2 0 0 cm BT /F1 10 Tf (A) Tj (B) Tj ET")[1]["x"] == 10.0
    assert [b["y"] for b in blocks(b"BT /F1 10 Tf 0 100 Td 0 -14 TD (A) Tj T* (B) Tj ET")] == [86.0, 72.0]
    assert blocks(b"BT /F1 10 Tf [-1000] TJ (A) Tj ET")[0]["x"] == 10.0
    assert blocks(b"BT /F1 -10 Tf (AB) Tj ET")[0]["width"] == 10.0


def test_scan_is_total():
    good = write([[("Helvetica", 12, 72, 700, "a (b) \\ é")]], links=[("http://x", [1, 2, 3, 4])])
    page = next(scan.page_content(good))
    assert page["blocks"][0]["text"] == "a (b) \\ é" and page["links"][0]["uri"] == "http://x" and page["page_width"] == 612.0
    for i in range(0, len(good), 7):
        for row in scan.page_content(good[:i] + b"\xff<<" + good[i + 3 :]):
            assert set(row) >= {"page", "error", "blocks"}


GOLDEN = {
    "headings": ([("Helvetica-Bold", 24, 740, "Annual Report"), ("Helvetica", 12, 700, "This report summarizes the results of the year."), ("Helvetica", 12, 686, "It is split into short sections."), ("Helvetica-Bold", 16, 640, "Results"), ("Helvetica", 12, 615, "Revenue grew steadily over the four quarters.")],
                 "# Annual Report\n\nThis report summarizes the results of the year. It is split into short sections.\n\n## Results\n\nRevenue grew steadily over the four quarters.\n\n"),
    "lists": ([("Helvetica-Bold", 20, 740, "Shopping")] + [("Helvetica", 12, 700 - 14 * i, t) for i, t in enumerate(("• Apples", "• Bread", "• Cheese", "1. Wash", "2. Slice", "3. Serve"))], "# Shopping\n\n- Apples\n- Bread\n- Cheese\n1. Wash\n2. Slice\n3. Serve\n"),
    "code": ([("Helvetica", 12, 740, "Run the following program:"), ("Courier", 10, 700, "func main() {"), ("Courier", 10, 688, '    fmt.Println("hi")'), ("Courier", 10, 676, "}"), ("Helvetica", 12, 640, "It prints a greeting.")],
             'Run the following program:\n\n```\nfunc main() {\n```\n\n    fmt.Println("hi")\n\n```\n}\n```\n\nIt prints a greeting.\n\n'),
    "columns": ([("Helvetica", 12, 700 - 14 * i, f"{side} column line {n}.", x) for side, x in (("Left", 72), ("Right", 330)) for i, n in enumerate(("one", "two", "three", "four"))],
                "\n\n".join(" ".join(f"{side} column line {n}." for n in ("one", "two", "three", "four")) for side in ("Left", "Right")) + "\n\n"),
}


def test_pages_to_markdown(spark):
    files = spark.createDataFrame([(name, bytearray(write([[(f, s, (x or [72])[0], y, t) for f, s, y, t, *x in runs]]))) for name, (runs, _) in GOLDEN.items()], "path string, content binary")
    got = {r.doc_id: r.md for r in plan.to_markdown(scan.part(scan.scan(files), "blocks")).collect()}
    assert got == {name: md for name, (_, md) in GOLDEN.items()}


def test_vision(spark):
    rows = spark.createDataFrame([([0.1, 0.9, 0.0, 0.2, 0.7, 0.1, 0.9, 0.0, 0.1, 0.0, 0.1, 0.8],)], "l array<double>")
    out = vision.ctc_decode(F.col("l"), 4, 3, F.array(F.lit("a"), F.lit("b")))
    assert rows.select(out["text"]).first()[0] == "ab"
    boxes = spark.createDataFrame([(1, 0, 0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0, 1, 0, 0.8, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 1, 0.7, 0.0, 0.0, 10.0, 10.0)], "doc_id int, page int, ord int, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.ord for r in vision.suppressed(boxes).collect()) == [0, 2]
    mask = [[0.9 if 5 <= y < 20 and 10 <= x < 30 else 0.0 for x in range(50)] for y in range(40)]
    maps = spark.createDataFrame([(1, [v for r in mask for v in r])], "doc_id int, p array<double>")
    assert tuple(vision.component_boxes(maps, "p", 50).first())[2:6] == (10, 5, 30, 20)


def test_tables(spark):
    rows = [(1, 0, i, float(10 + 40 * (i % 3)), float(100 - 20 * (i // 3)), f"c{i}") for i in range(6)]
    b = spark.createDataFrame(rows, "doc_id int, page int, ord int, x double, y double, text string")
    cells = {(r.row, r.col): r.content for r in tables.table_cells(b).collect()}
    assert cells == {(i // 3, i % 3): f"c{i}" for i in range(6)}


def test_links_and_detections(spark):
    e = frame(spark, [element("here", 10, 10, 100, 10), element("there", 10, 30, 100, 10)])
    links = spark.createDataFrame([(1, 0, 0, "u", 10.0, 10.0, 110.0, 20.0), (1, 0, 1, "v", 10.0, 10.0, 110.0, 20.0)], "doc_id int, page int, link_ord int, uri string, x1 double, y1 double, x2 double, y2 double")
    assert [r.content for r in layout.link_elements(e, links).orderBy("ord").collect()] == ["[here](u)", "there"]
    found = spark.createDataFrame([(1, 0, 0, 10.0, 10.0, 110.0, 20.0, 0.9, 5), (1, 0, 1, 10.0, 30.0, 110.0, 40.0, 0.1, 0)], "doc_id int, page int, ord int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int")
    assert [r.type for r in layout.fuse_detections(e, found).orderBy("ord").collect()] == ["table", "paragraph"]
    assert layout.confident(found, 0.25, 0).count() == 0 and layout.fuse_detections(e, None) is e


def test_models_and_metrics(spark, tmp_path, monkeypatch):
    from folioframe.sources import models
    from folioframe.sources.pdf import afm

    (tmp_path / "dict.txt").write_text("a\n\nb\n")
    assert [tuple(r) for r in models.dictionary(spark, f"{tmp_path}/dict.txt").collect()] == [(1, "a"), (2, "b")]
    monkeypatch.setenv("SOME_MODEL", f"{tmp_path}/dict.txt")
    assert models.find("x.onnx", variable="SOME_MODEL") == f"{tmp_path}/dict.txt" and models.find("x.onnx", folder=str(tmp_path)) is None
    assert models.compose(lambda v: v + 1, lambda v: v * 2)(3) == 8
    (tmp_path / "Some.afm").write_text("StartFontMetrics 4.1\nC 32 ; WX 278 ; N space ; B 0 0 0 0 ;\nC 65 ; WX 667 ; N A ; B 14 0 654 718 ;\n")
    assert {(r.font, r.code, r.width) for r in afm.metrics(spark, str(tmp_path)).collect()} == {("Some", 32, 278.0), ("Some", 65, 667.0)}
    assert afm.widths((tmp_path / "Some.afm").read_text()) == {" ": 278.0, "A": 667.0}


def test_encrypted_file():
    import hashlib

    body, ident, p = write([[("Helvetica", 12, 72, 700, "secret")]], compress=False), b"0123456789abcdef", -44
    o = bytes(range(32))
    key = hashlib.md5(crypt.PAD + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + ident).digest()[:5]
    u = crypt.rc4(key, crypt.PAD)
    start = body.index(b"stream\n") + 7
    end = body.index(b"\nendstream")
    num = int(body[: body.rindex(b" 0 obj", 0, start)].rsplit(b"\n", 1)[-1])
    own = hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0").digest()[:10]
    locked = body[:start] + crypt.rc4(own, body[start:end]) + body[end:]
    enc = b"/Encrypt << /Filter /Standard /V 1 /R 2 /P -44 /O <" + o.hex().encode() + b"> /U <" + u.hex().encode() + b"> >> /ID [<" + ident.hex().encode() + b"> <00>] /Root"
    page = next(scan.page_content(locked.replace(b"/Root", enc, 1)))
    assert page["error"] is None and page["blocks"][0]["text"] == "secret"
    bad = enc.replace(u.hex().encode(), (b"00" * 32))
    assert "password" in next(scan.page_content(locked.replace(b"/Root", bad, 1)))["error"]


def test_svg_and_saved_images(spark, tmp_path):
    from folioframe.operators import sinks

    ops = [("M", [(0.0, 0.0)]), ("C", [(1.0, 1.0), (2.0, 2.0), (9.0, 9.0)])]
    g = spark.createDataFrame([("d/x.pdf", 1, 0, "Path1", ops, 1.0, True, False, 0.0, 0.0, 10.0, 10.0), ("d/x.pdf", 1, 1, "Path2", ops[:1], 1.0, True, False, 0.0, 0.0, 10.0, 10.0)], "doc_id string, page int, ord int, id string, ops array<struct<op:string,points:array<struct<x:double,y:double>>>>, line_width double, is_stroked boolean, is_filled boolean, x double, y double, width double, height double")
    paths = [r.id for r in sinks.save_graphics(g, str(tmp_path)).orderBy("ord").collect()]
    assert re.fullmatch(r"images/x_[0-9a-f]{8}_p1_1\.svg", paths[0]) and (tmp_path / paths[0]).read_text().startswith("<svg")
    i = spark.createDataFrame([("../../etc", 1, 0, "../evil", bytearray(b"png"), "png", 0.0, 0.0, 1.0, 1.0)], "doc_id string, page int, ord int, id string, data binary, format string, x double, y double, width double, height double")
    assert [re.sub("_[0-9a-f]{8}_", "_", r.id) for r in sinks.save_images(i, str(tmp_path)).collect()] == ["images/etc_p1_1.png"]


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("band", [1, 3, 64])
def test_edit_distance(monkeypatch, band):
    monkeypatch.setattr(edits, "LEAST_BAND", band)
    r = random.Random(band)
    for n in range(1500):
        a = "".join(r.choice("abcé") for _ in range(r.randint(0, 14)))
        b = "".join(r.choice("abcd") for _ in range(r.randint(0, 14))) if n % 2 else "".join(c for c in a if r.random() > 0.2)
        assert edits.distance(a, b) == brute_distance(a, b)


def test_edit_distance_of_long_texts():
    a = "the quick brown fox jumps over the lazy dog. " * 4000
    assert edits.distance(a, a) == 0
    assert edits.distance(a, a.replace("quick", "quack")) == 4000
    assert edits.distance("", a) == len(a)


def test_similarity(spark):
    rows = spark.createDataFrame([("a b", "A  b"), ("", ""), ("", "x"), ("abcd", "abce"), (None, "x")], "gen string, gt string")
    assert [r[0] for r in rows.select(scoring.similarity(F.col("gen"), F.col("gt"))).collect()] == [1.0, 1.0, 0.0, 0.75, None]


def test_sinks_keep_what_is_there(spark, tmp_path):
    from folioframe.operators import sinks

    schema = "doc_id string, page int, ord int, id string, data binary, format string, x double, y double, width double, height double"
    rows = [(f"{d}/x.pdf", 1, 0, "Im", bytearray(d.encode()), "png", 0.0, 0.0, 1.0, 1.0) for d in "ab"]
    names = sorted(r.id for r in sinks.save_images(spark.createDataFrame(rows, schema), str(tmp_path)).collect())
    assert len(set(names)) == 2 and sorted((tmp_path / n).read_bytes() for n in names) == [b"a", b"b"]
    docs = lambda *r: spark.createDataFrame(list(r), "doc_id string, md string")
    sinks.write_markdown(docs(("a/x.pdf", "one"), ("b/x.pdf", "two")), str(tmp_path))
    sinks.write_markdown(docs(("a/x.pdf", "three"), ("a/y.pdf", "four")), str(tmp_path))
    texts = sorted(p.read_text() for p in tmp_path.glob("doc=*/*.txt"))
    assert texts == ["four\n", "three\n", "two\n"] and all((tmp_path / n).exists() for n in names)


def test_margins_by_each_page_s_own_height(spark):
    rows = [(1, 0, k, f"t{k}", 0.0, y, h) for k, (y, h) in enumerate([(835.0, 842.0), (770.0, 842.0), (770.0, 792.0), (5.0, 792.0)])]
    b = spark.createDataFrame(rows, "doc_id int, page int, ord int, text string, x double, y double, page_height double")
    assert [r.text for r in layout.exclusion_zone(b, 0.0, 30, 10).collect()] == ["t1"]
    assert [r.text for r in layout.exclusion_zone(b.drop("page_height"), 842.0, 30, 0).collect()] == ["t1", "t2", "t3"]


def test_replayed_batch_replaces_what_it_wrote(spark, tmp_path):
    from folioframe.streaming import markdown_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(write([[("Helvetica", 12, 72, 700, "some plain words of a page here")]]))
    for attempt in ("one", "two"):  # a lost checkpoint runs batch 0 again
        q = markdown_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / attempt))
        q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 1 and "some plain words" in rows[0].md


def test_standard_fonts():
    from folioframe.sources.pdf import encodings, metrics
    from folioframe.sources.pdf.fonts import Font

    class Doc:
        get = staticmethod(lambda x: x)

    for base in ("Helvetica", "ABCDEF+Helvetica"):
        f = Font(Doc, {"Subtype": "Type1", "BaseFont": base, "Encoding": "WinAnsiEncoding"}, "F1")
        assert f.width(ord("A")) == 667 and f.space_width() == 278
    assert Font(Doc, {"Subtype": "Type1", "BaseFont": "Other"}, "F1").width(65) == 500
    assert Font(Doc, {"Subtype": "Type1", "BaseFont": "Other", "FontDescriptor": {"MissingWidth": 300}}, "F1").width(65) == 300
    standard = Font(Doc, {"Subtype": "Type1", "BaseFont": "Times-Roman"}, "F1")
    assert [standard.decode(c) for c in (0xAE, 0xAF, 0xAA, 0xE1, 0xFA, 0xB1, 0xA6, 0xF5, 0xE8, 0xA0)] == ["fi", "fl", "“", "Æ", "œ", "–", "ƒ", "ı", "Ł", "\ufffd"]
    named = Font(Doc, {"Subtype": "Type1", "BaseFont": "X", "Encoding": {"Differences": [65, "summation", "radicalBig", "uni20AC", "nosuchglyph", 200, "Aogonek"]}}, "F1")
    assert [named.decode(c) for c in (65, 66, 67, 68, 200)] == ["∑", "√", "€", "D", "Ą"]
    assert metrics.metrics("Times-Bold").width("Eacute", 0) == metrics.metrics("Times-Bold").width("E", 0) == 667
    assert all(encodings.glyph_text(n) for e in ("StandardEncoding", "WinAnsiEncoding", "MacRomanEncoding") for n in encodings.codes_of(e).values())


def test_tables_and_what_they_consume(spark):
    from folioframe.operators import tables

    block = "doc_id int, page int, ord int, text string, x double, y double, width double, height double"
    cells = [(d, 0, 2 * r + c, f"{r}{c}", 100.0 + 100 * c, 700.0 - 20 * r, 30.0, 10.0) for d in (1, 2) for r in range(3) for c in range(2)]
    rows = [*cells, (1, 0, 90, "outside", 400.0, 300.0, 50.0, 10.0), (3, 0, 0, "alone", 0.0, 0.0, 1.0, 1.0)]
    b = spark.createDataFrame(rows, block)
    line = lambda x1, y1, x2, y2: [("M", [(x1, y1)]), ("L", [(x2, y2)])]
    ruled = [line(95.0, y, 300.0, y) for y in (645.0, 690.0, 715.0)] + [line(x, 645.0, x, 715.0) for x in (95.0, 195.0, 300.0)]
    g = spark.createDataFrame([(1, 0, i, ops, True) for i, ops in enumerate(ruled)], "doc_id int, page int, ord int, ops array<struct<op:string,points:array<struct<x:double,y:double>>>>, is_stroked boolean")
    found, consumed = tables.detect_tables(b, g)
    got = {(r.doc_id, r.kind, r.row, r.col): r.content for r in found.collect()}
    assert got == {(1, "ruled", r, c): f"{r}{c}" for r in range(3) for c in range(2)} | {(2, "aligned", r, c): f"{r}{c}" for r in range(3) for c in range(2)}
    assert [r.text for r in tables.unconsumed(b, consumed).orderBy("doc_id").collect()] == ["outside", "alone"]


def test_benchmark_and_command_line(spark, tmp_path, capsys):
    import json

    from folioframe import __main__ as cli
    from folioframe import benchmark

    for name, text, truth in (("one", "first words of a plain page", "first words of a plain page\n"), ("two", "other words stand on this page", "other wordsstand on this page"), ("three", "no truth", None)):
        for kind in ("pdf", "markdown"):
            (tmp_path / "data" / "set" / kind).mkdir(parents=True, exist_ok=True)
        (tmp_path / "data" / "set" / "pdf" / f"{name}.pdf").write_bytes(write([[("Helvetica", 12, 72, 700, text)]]))
        if truth:
            (tmp_path / "data" / "set" / "markdown" / f"{name}.md").write_text(truth)
    base = str(tmp_path / "base.json")
    assert benchmark.main([str(tmp_path / "data"), "--baseline", base, "--update-baseline"]) == 0
    held = json.loads(open(base).read())["scores"]
    assert set(held) == {"set/pdf/one.pdf", "set/pdf/two.pdf"} and held["set/pdf/one.pdf"] == 1.0 and 0.9 < held["set/pdf/two.pdf"] < 1
    assert benchmark.main([str(tmp_path / "data"), "--baseline", base, "--spacing-examples", "3", "--output", str(tmp_path / "md")]) == 0
    assert "split: words|stand" in capsys.readouterr().out and len(list((tmp_path / "md").glob("doc=*"))) == 2
    open(base, "w").write(json.dumps({"dataset": "d", "tool": "t", "scores": {"set/pdf/two.pdf": 1.0, "gone": 0.5}}))
    assert benchmark.main([str(tmp_path / "data"), "--baseline", base]) == 1
    assert cli.main(["--version"]) == 0 and cli.main([]) == 0
    assert cli.main([str(tmp_path / "data" / "set" / "pdf" / "one.pdf"), "--no-onnx", "--no-ocr", "--exclude-top", "20"]) == 0
    assert "first words of a plain page" in capsys.readouterr().out


def test_written_files_read_back():
    from folioframe.sources.pdf import filters
    from folioframe.sources.pdf import writer as W

    r = random.Random(2)
    for n in (0, 1, 300, 20_000):
        data = bytes(r.choice(b"abcde \n") for _ in range(n))
        assert filters.lzw(W.lzw_encoded(data)) == data and filters.unpredicted(W.predicted(data, 7), 15, 7)[:n] == data
    for kind in (None, "rc4-40", "rc4-128", "aes-128", "aes-256"):
        for word in ("", "secret"):
            b = W.Builder()
            font = b.add(f"<< {W.PLAIN} >>".encode())
            b.page(b.stream(W.lines_content(["Hello (x) é"])), f"/Font << /F1 {font} 0 R >>")
            pages = list(scan.page_content(b.finished(packed=word == "", lock=W.Lock(kind, word) if kind else None), word))
            assert pages[0]["error"] is None and [x["text"] for x in pages[0]["blocks"]] == ["Hello (x) é"]


def test_recognition_tensors():
    from folioframe.operators import vision

    image = np.zeros((24, 100, 3), np.uint8)
    image[:, 50:] = 255
    r = vision.recognition_tensor(image, (0, 0, 100, 24))
    assert r.shape == (3, 48, 320) and r[0, 0, 0] == -1 and r[0, 0, 190] == 1 and (r[:, :, 200:] == 0).all()
    assert vision.recognition_tensor(image, (200, 0, 300, 24)) is None
    d = vision.detection_tensor(image)
    assert d.shape == (3, 960, 4000) and d[0, 0, 0] == pytest.approx(-0.485 / 0.229) and d[2, 5, 3990] == pytest.approx((1 - 0.406) / 0.225)


def test_model_files(tmp_path):
    import hashlib

    from folioframe.sources import models

    path = tmp_path / "m.onnx"
    path.write_bytes(b"model")
    assert models.verified(str(path), hashlib.sha256(b"model").hexdigest()) == str(path) and models.verified(str(path), "0" * 64) is None
    assert models.verified(None, "x") is None and models.verified(str(path)) == str(path)
