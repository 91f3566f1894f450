"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

1. language: documents whose language can't be told (no letters, or a score under LEAST_SCORE) go.
2. near_dedup: one document of each class of near-duplicates stays, that with the smallest id.
3. decontaminate: documents with a benchmark window go.
4. mix: each document comes as often as its source's target weight asks, whole; some come twice, some not at all.
5. tokens: ids in a content-addressed store; per document its place, length and checksum, read back from the files.

All stages but the last return the columns of documents, whatever these are named. A null or empty text has no letters, so
stage 1 drops it. Rows are told apart by id and text: null and repeated ids are documents of their own, rows that repeat
both are copies, and of copies and near copies the row with the smallest id stays (null last). An empty table gives an
empty result. The stages before the last are working tables; run() deletes each when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.common import drop_all, load, written
from folioframe.llm.decontaminate import decontaminated
from folioframe.llm.language_id import learn, predict
from folioframe.llm.mixing import mixed
from folioframe.llm.near_dedup import deduplicated
from folioframe.llm.token_store import token_digests

#: A text this far from all profiles is in none of their languages; clean texts score over twice as much.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    label, score = "pipeline: language", "pipeline: score"  # names that no table has
    found = predict(docs, learn(docs), keep=tuple(docs.columns), label=label, score=score)
    return found.filter((F.col(label) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(docs, "pipeline-tokens").drop("root")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Near-duplicates and token ids can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_all(before)
        before = docs
    return docs
