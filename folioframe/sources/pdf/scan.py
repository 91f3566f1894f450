"""From files to rows: page_content(bytes) in a task, scan(DataFrame of binaryFile) over a cluster, a Python data source."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .interpreter import Interpreter
from .objects import Document, Stream

BLOCK = "ord int, text string, x double, y double, width double, height double, font_size double, font_name string, space_width double, render_mode int"
IMAGE = "ord int, id string, data binary, format string, x double, y double, width double, height double"
GRAPHIC = "ord int, id string, ops array<struct<op:string,points:array<struct<x:double,y:double>>>>, line_width double, is_stroked boolean, is_filled boolean, x double, y double, width double, height double"
LINK = "ord int, uri string, x1 double, y1 double, x2 double, y2 double"
nested = lambda s: "array<struct<" + ",".join(f.replace(" ", ":", 1) for f in s.split(", ")) + ">>"
SCHEMA = f"page int, page_width double, page_height double, error string, blocks {nested(BLOCK)}, images {nested(IMAGE)}, graphics {nested(GRAPHIC)}, links {nested(LINK)}"
ROWS = 10_000  #: blocks, pages and kilobytes of images that a batch of pages holds, or one page more
NAMES = ["page", "page_width", "page_height", "error", "blocks", "images", "graphics", "links"]


def page_content(data: bytes, password: str = "") -> Iterator[dict]:
    """A row for each page; what can't be read becomes a row with an error, never an exception."""
    empty = {"blocks": [], "images": [], "graphics": [], "links": [], "page_width": 0.0, "page_height": 0.0}
    try:
        doc = Document(data, password)
        pages = list(doc.pages())
    except Exception as e:  # noqa: BLE001  a hostile file must not end a task
        yield empty | {"page": 0, "error": f"{type(e).__name__}: {e}"}
        return
    for n, page in enumerate(pages, 1):
        row = empty | {"page": n, "error": None}
        try:
            box = [float(doc.get(v)) for v in doc.get(page.get("MediaBox")) or []]
            if len(box) == 4:
                row |= {"page_width": abs(box[2] - box[0]), "page_height": abs(box[3] - box[1])}
            row["links"] = links_of(doc, page)
            parts = doc.get(page.get("Contents"))
            parts = [doc.get(p) for p in parts] if isinstance(parts, list) else [parts]
            content = b" ".join(doc.decoded(p) for p in parts if isinstance(p, Stream))
            run = Interpreter(doc, doc.get(page.get("Resources")) or {})
            run.run(content)
            for name in ("blocks", "images", "graphics"):
                row[name] = [x | {"ord": i} for i, x in enumerate(getattr(run, name))]
        except Exception as e:  # noqa: BLE001
            row |= {"error": f"{type(e).__name__}: {e}"}
        yield row


def links_of(doc, page: dict) -> list[dict]:
    out = []
    for ref in doc.get(page.get("Annots")) or []:
        a = doc.get(ref)
        action = doc.get(a.get("A")) if isinstance(a, dict) and doc.get(a.get("Subtype")) == "Link" else None
        if not isinstance(action, dict) or doc.get(action.get("S")) != "URI":
            continue
        uri, rect = doc.get(action.get("URI")), [doc.get(v) for v in doc.get(a.get("Rect")) or []]
        if isinstance(uri, bytes) and len(rect) == 4:
            out.append({"ord": len(out), "uri": uri.decode("utf-8", "replace")} | dict(zip(("x1", "y1", "x2", "y2"), map(float, rect))))
    return out


def scan(files: DataFrame, content: str = "content", key: str = "path", password: str = "") -> DataFrame:
    """key as doc_id and a row per page. files: as spark.read.format("binaryFile") gives them, or any with bytes in a column."""
    rows = files.select(F.col(key).alias("doc_id"), F.col(content).alias("content"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, {SCHEMA}"

    def run(batches):
        for batch in batches:
            schema = pa.schema([("doc_id", batch.column("doc_id").type), *arrow_fields()])
            held, size = [], 0
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("content")):
                data = data.as_py() or b""
                for page in page_content(data, password):
                    held.append({"doc_id": doc_id} | page)
                    size += 1 + len(page["blocks"]) + sum(len(x["data"] or b"") for x in page["images"]) // 1000
                    if size >= ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema)

    return rows.mapInArrow(run, schema)


def arrow_fields() -> list[tuple[str, pa.DataType]]:
    d, s, i = pa.float64(), pa.string(), pa.int32()
    box = [("x", d), ("y", d), ("width", d), ("height", d)]
    ops = pa.list_(pa.struct([("op", s), ("points", pa.list_(pa.struct([("x", d), ("y", d)])))]))
    block = [("ord", i), ("text", s), *box, ("font_size", d), ("font_name", s), ("space_width", d), ("render_mode", i)]
    image = [("ord", i), ("id", s), ("data", pa.binary()), ("format", s), *box]
    graphic = [("ord", i), ("id", s), ("ops", ops), ("line_width", d), ("is_stroked", pa.bool_()), ("is_filled", pa.bool_()), *box]
    link = [("ord", i), ("uri", s), ("x1", d), ("y1", d), ("x2", d), ("y2", d)]
    return [("page", i), ("page_width", d), ("page_height", d), ("error", s), *((n, pa.list_(pa.struct(f))) for n, f in (("blocks", block), ("images", image), ("graphics", graphic), ("links", link)))]


def read(spark: SparkSession, path: str, password: str = "", pattern: str = "*.pdf") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return scan(files, password=password)


def part(pages: DataFrame, name: str) -> DataFrame:
    """doc_id, page and the fields of one kind: blocks (with page_height), images, graphics or links."""
    own = ["page_height"] if name == "blocks" else []
    out = pages.select("doc_id", "page", *own, F.inline(name))
    return out.withColumn("link_uri", F.lit(None).cast("string")) if name == "blocks" else out.withColumnRenamed("ord", "link_ord") if name == "links" else out


class PageSource(DataSource):
    """spark.read.format("folio_pages").option("files", "a.pdf,b.pdf").load(): pages of local files, one task a file."""

    @classmethod
    def name(cls) -> str:
        return "folio_pages"

    def schema(self) -> str:
        return f"doc_id string, {SCHEMA}"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.password = [f for f in options.get("files", "").split(",") if f], options.get("password", "")

    def partitions(self):
        return [InputPartition(f) for f in self.files]

    def read(self, partition):
        """A batch for each page. The files must lie where every executor finds them."""
        schema = pa.schema([("doc_id", pa.string()), *arrow_fields()])
        with open(partition.value, "rb") as f:
            data = f.read()
        for page in page_content(data, self.password):
            yield pa.RecordBatch.from_pylist([{"doc_id": partition.value} | page], schema)
