"""Finding model files and reading OCR dictionaries. Nothing is downloaded."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_FOLDER = "~/.cache/folioframe"


def find(name: str, configured: str | None = None, variable: str | None = None, folder: str = DEFAULT_FOLDER) -> str | None:
    """The first that exists: the configured path, the one in an environment variable, the file in the cache folder. None: unavailable."""
    for path in (configured, os.environ.get(variable) if variable else None, os.path.join(os.path.expanduser(folder), name)):
        if path and os.path.isfile(path):
            return path
    return None


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """class (from 1; 0 is the blank) and char: one character a line, blank lines skipped, in order."""
    whole = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, "\r$", "")), lambda x: x != "").alias("c"))
    return whole.select(F.posexplode("c").alias("k", "char")).select((F.col("k") + 1).alias("class"), "char")


def verified(path: str | None, sha256: str | None = None) -> str | None:
    """The path if its file has that digest (any, where none is asked for); a file that has another is no model."""
    if path is None or sha256 is None:
        return path
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return path if digest.hexdigest() == sha256.lower() else None


def compose(*steps: Callable) -> Callable:
    """Image transforms one after another."""

    def run(image):
        for s in steps:
            image = s(image)
        return image

    return run
