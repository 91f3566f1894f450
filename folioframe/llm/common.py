"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import own_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates words, before lower-casing: everything ASCII but digits and letters.
NONWORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    return own_folder(spark, name)


def tasks_for(spark: SparkSession, rows: int, width: int) -> int:
    """How many tasks some rows of so many bytes call for: one for each 8 MB, and two for each core at least."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows * width // (8 << 20)))


def written(df: DataFrame, name: str, path: str | None = None, tasks: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: this cuts lineage and survives the loss of executors. tasks: at most so many write, and as many files come out."""
    spark = df.sparkSession
    path = path or work_path(spark, name)
    df = df.coalesce(tasks) if tasks else df
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a working table, through Hadoop's file system interface."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def paths_of(df: DataFrame) -> list[str]:
    return sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})


def drop_all(*tables: DataFrame) -> None:
    """Delete the working tables that these are read from."""
    for t in tables:
        for p in paths_of(t):
            drop_path(t.sparkSession, p)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() is faster and does the same for text that is all ASCII."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def word_string(text: Column) -> Column:
    """The words of a text in order, as ' a  b  c ': a space on both sides of each word. Case is kept; null gives ''."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NONWORD, "  "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def word_count(words: Column) -> Column:
    """How many words a word_string holds."""
    gaps = (F.octet_length(words) - F.octet_length(F.replace(words, F.lit("  "), F.lit("")))) / 2
    return F.when(words == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def word_array(text: Column) -> Column:
    """The words of a text, lower-cased; an empty array for null."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NONWORD, " "))
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(ascii_lower(words), " "))


#: The same for DuckDB.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def small_batches(spark: SparkSession, most: int = 2000) -> None:
    """Let Arrow batches hold at most so many rows: workers share an executor's memory, and texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > most:
        spark.conf.set(key, most)
