"""Widths of standard fonts from AFM files, where a folder with them is named: spark.conf folioframe.afm.dir, or widths(path)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encodings import glyph_text

METRIC = r"^C\s+(-?\d+)\s*;\s*WX\s+([\d.]+)\s*;\s*N\s+(\S+)\s*;"


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """font, code, width, glyph: a row for each character metric of the AFM files in a folder."""
    lines = spark.read.option("pathGlobFilter", "*.afm").text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.afm$", 1).alias("font"), F.trim("value").alias("v"))
    hit = lines.filter(F.regexp_like("v", F.lit(METRIC)))
    part = lambda k: F.regexp_extract("v", METRIC, k)
    return hit.select("font", part(1).cast("int").alias("code"), part(2).cast("double").alias("width"), part(3).alias("glyph"))


def widths(text: str) -> dict[str, float]:
    """Widths by character of one AFM file's text."""
    found = re.finditer(METRIC, text, re.M)
    return {t: float(m[2]) for m in found if (t := glyph_text(m[3])) is not None}
