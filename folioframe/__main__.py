"""python -m folioframe INPUT [OUTPUT]: files below a path (or one file) to Markdown."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from . import __version__
from .config import PRESETS, from_session
from .operators.sinks import save_graphics, save_images, write_markdown
from .plans.layout import to_markdown
from .sources import models
from .sources.pdf import scan


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioframe", description=__doc__)
    p.add_argument("input", nargs="?")
    p.add_argument("output", nargs="?", help="folder for the results; without it they go to standard output")
    p.add_argument("-V", "--version", action="store_true")
    p.add_argument("--debug", action="store_true", help="log more")
    p.add_argument("--exclude-top", type=float, default=0.0, help="points at the top of each page to leave out")
    p.add_argument("--exclude-bottom", type=float, default=0.0, help="points at the bottom of each page to leave out")
    p.add_argument("--password", default=os.environ.get("FOLIOFRAME_PASSWORD", ""), help="user password; the blank one is always tried first")
    p.add_argument("--preset", choices=sorted(PRESETS), default="default")
    p.add_argument("--images", action="store_true", help="save images and drawings beside the results")
    p.add_argument("--no-onnx", action="store_true", help="rules only, no layout model")
    p.add_argument("--model-path", help="layout model")
    p.add_argument("--runtime-path", help="library that runs models")
    p.add_argument("--no-ocr", action="store_true", help="no recognition of pages that are images")
    p.add_argument("--ocr-det-model-path", help="text detection model")
    p.add_argument("--ocr-rec-model-path", help="text recognition model")
    p.add_argument("--ocr-dict-path", help="characters of the recognition model, one a line")
    return p


def found_models(a: argparse.Namespace) -> dict[str, str | None]:
    """The model files that are asked for and exist. Rules do without; pages that are images stay empty without."""
    layout = None if a.no_onnx else models.find("layout.onnx", a.model_path, "FOLIOFRAME_MODEL")
    ocr = {k: None if a.no_ocr else models.find(name, path, variable) for k, name, path, variable in (("detection", "ocr_det.onnx", a.ocr_det_model_path, "FOLIOFRAME_OCR_DET"), ("recognition", "ocr_rec.onnx", a.ocr_rec_model_path, "FOLIOFRAME_OCR_REC"), ("characters", "ocr_dict.txt", a.ocr_dict_path, "FOLIOFRAME_OCR_DICT"))}
    return {"layout": layout, **ocr}


def main(argv: list[str] | None = None) -> int:
    parser = arguments()
    a = parser.parse_args(argv)
    if a.version:
        print(f"folioframe {__version__}")
        return 0
    if not a.input:
        parser.print_help()
        return 0
    spark = SparkSession.builder.appName("folioframe").getOrCreate()
    if a.debug:
        spark.sparkContext.setLogLevel("INFO")
        print(f"models: {found_models(a)}", file=sys.stderr)
    config = replace(from_session(spark, a.preset), exclude_top=a.exclude_top, exclude_bottom=a.exclude_bottom)
    pages = scan.read(spark, a.input, a.password)
    parts = {}
    if a.images and a.output:
        parts = {"images": save_images(scan.part(pages, "images"), a.output), "graphics": save_graphics(scan.part(pages, "graphics"), a.output)}
    out = to_markdown(scan.part(pages, "blocks"), config, links=scan.part(pages, "links"), **parts)
    if a.output:
        write_markdown(out, a.output)
    else:
        for row in out.orderBy("doc_id").toLocalIterator():
            sys.stdout.write(row["md"])
    for row in pages.filter("error is not null").select("doc_id", "page", "error").toLocalIterator():
        print(f"{os.path.basename(row['doc_id'])}, page {row['page']}: {row['error']}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
