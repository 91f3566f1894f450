"""Files out: Markdown per document, images, drawings as SVG. Names come from numbers, never from a document."""

from __future__ import annotations

import contextlib
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import svg_path
from .tables import trivial_graphic


def file_name(doc_id: Column) -> Column:
    """A document's name in file names: its base name, and eight digits of its whole name's hash, so that no two share one."""
    whole = doc_id.cast("string")
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(whole, r"([^/]*)$", 1), r"\.\w+$", ""), r"[^A-Za-z0-9_-]", "_")
    return F.concat(stem, F.lit("_"), F.substring(F.md5(whole.cast("binary")), 1, 8))


def local(folder: str) -> str | None:
    """folder as a path of the file system, or None where it lies in another store."""
    path = re.sub("^file:/+", "/", folder)
    return None if "://" in path else path


def write_markdown(docs: DataFrame, folder: str) -> None:
    """One text file per document below doc=<name>/; what else is in the folder, as images or other documents, stays."""
    if local(folder):
        markdown_files(docs, folder).write.format("noop").mode("overwrite").save()
        return
    named = docs.select(file_name(F.col("doc_id")).alias("doc"), "md")
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc").option("lineSep", "\n").text(folder)


def markdown_files(docs: DataFrame, folder: str) -> DataFrame:
    """path, below folder, of each document's file, written as the rows are read. The folder must be one that all executors share.

    Tasks write for themselves, as a table with a partition for each document costs a listing and a commit of each. A file
    is complete when it has its name; a task that runs again gives the same names. Older files of a document are removed.
    """
    root, run_id = local(folder), uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        nth, task = 0, TaskContext.get().partitionId()
        os.makedirs(root, exist_ok=True)
        for b in batches:
            paths = []
            for doc, body in zip(b.column("doc").to_pylist(), b.column("md").to_pylist()):
                under = f"doc={doc or '__HIVE_DEFAULT_PARTITION__'}"
                own = os.path.join(root, under)
                try:
                    os.mkdir(own)
                except FileExistsError:
                    for old in os.listdir(own):
                        if old.endswith(".txt") and not old.startswith((run_id, ".")):
                            with contextlib.suppress(FileNotFoundError):
                                os.remove(os.path.join(own, old))
                name = f"{run_id}-{task}-{nth}.txt"
                with open(os.path.join(own, f".{name}"), "wb") as f:
                    f.write((body or b"") + b"\n")
                os.replace(os.path.join(own, f".{name}"), os.path.join(own, name))
                paths.append(f"{under}/{name}")
                nth += 1
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return docs.select(file_name(F.col("doc_id")).alias("doc"), F.col("md").cast("binary").alias("md")).mapInArrow(run, "path string")


def read_files(paths: DataFrame, folder: str, most: int = 1 << 23) -> DataFrame:
    """path, content of the files below folder that a column path names, some megabytes at a time; none is listed."""
    root = local(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])
        for b in batches:
            names, bodies, size = [], [], 0
            for path in b.column("path").to_pylist():
                with open(os.path.join(root, path), "rb") as f:
                    bodies.append(f.read())
                names.append(path)
                size += len(bodies[-1])
                if size >= most:
                    yield pack()
                    names, bodies, size = [], [], 0
            yield pack()

    return paths.select("path").mapInArrow(run, "path string, content binary")


def placed(rows: DataFrame, folder: str, kind) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord"))
    return rows.withColumn("path", F.format_string("images/%s_p%d_%d.%s", file_name(F.col("doc_id")), "page", nth, kind))


def saved(rows: DataFrame, folder: str, data: str) -> DataFrame:
    """rows with id set to the path written, or '' where that failed. The folder must be one that all executors share."""
    schema, folder = rows.schema, re.sub("^file:/+", "/", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for path, body in zip(b.column("path").to_pylist(), b.column(data).to_pylist()):
                try:
                    full = os.path.join(folder, path)
                    os.makedirs(os.path.dirname(full), mode=0o750, exist_ok=True)
                    with open(full, "wb") as f:
                        f.write(body if isinstance(body, bytes) else body.encode())
                    ids.append(path)
                except OSError:
                    ids.append("")
            yield b.set_column(b.schema.get_field_index("id"), "id", pa.array(ids))

    return rows.mapInArrow(run, schema)


def save_images(images: DataFrame, folder: str) -> DataFrame:
    return saved(placed(images, folder, F.col("format")), folder, "data").drop("path", "data")


def svg_text(graphics: DataFrame, pad: float = 5.0) -> DataFrame:
    """graphics with svg; '' for trivial ones."""
    w, h = F.col("width") + 2 * pad, F.col("height") + 2 * pad
    path = svg_path(F.col("ops"), F.col("height"), F.col("x"), F.col("y"), pad)
    stroke, fill = F.when(F.col("is_stroked"), "black").otherwise("none"), F.when(F.col("is_filled"), "black").otherwise("none")
    text = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%.2f" height="%.2f"><path d="%s" stroke="%s" fill="%s" stroke-width="%.2f"/></svg>', w, h, path, stroke, fill, "line_width")
    return graphics.withColumn("svg", F.when(trivial_graphic(F.col("ops")), "").otherwise(text))


def save_graphics(graphics: DataFrame, folder: str) -> DataFrame:
    rows = placed(svg_text(graphics), folder, F.lit("svg"))
    kept = saved(rows.filter("svg <> ''"), folder, "svg")
    return kept.unionByName(rows.filter("svg = ''").withColumn("id", F.lit(""))).drop("path", "svg")
