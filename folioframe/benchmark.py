"""python -m folioframe.benchmark DATA: convert every page file below DATA, score it against its ground truth, compare with a baseline.

DATA holds <subset>/pdf/<name>.pdf and <subset>/markdown/<name>.md. Files without a ground truth, or that can't be read,
are left out.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, Config
from .operators import scoring as S
from .plans.layout import to_markdown
from .sources.pdf import scan


def generated(spark: SparkSession, root: str, config: Config = DEFAULT, password: str = "") -> DataFrame:
    """file, gen: the Markdown of every page file below root."""
    pages = scan.read(spark, root, password)
    md = to_markdown(scan.part(pages, "blocks"), config, links=scan.part(pages, "links"))
    return md.select(S.below(F.col("doc_id"), root).alias("file"), F.col("md").alias("gen"))


def pairs(spark: SparkSession, root: str, config: Config = DEFAULT) -> DataFrame:
    """file, gen, gt of the files that have both."""
    return generated(spark, root, config).join(S.ground_truth_pairs(spark, root), "file")


def scores(both: DataFrame) -> DataFrame:
    """file, subset, score (similarity), word_f1, heading_f1, heading_text_f1, n_split, n_glued."""
    out = both.select("file", F.regexp_extract("file", "^([^/]*)", 1).alias("subset"), S.similarity(F.col("gen"), F.col("gt")).alias("score"))
    for part in (S.word_f1(both), S.heading_f1(both), S.heading_f1(both, with_level=False), S.spacing_errors(both)):
        out = out.join(part, "file", "left")
    return out.fillna({"n_split": 0, "n_glued": 0})


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="folioframe.benchmark", description=__doc__)
    p.add_argument("data")
    p.add_argument("--baseline", default="benchmark_baseline.json", help="file of scores to compare with")
    p.add_argument("--update-baseline", action="store_true", help="write the scores as the new baseline instead")
    p.add_argument("--tolerance", type=float, default=0.02, help="drop of a file's score that is allowed")
    p.add_argument("--output", help="folder for the Markdown")
    p.add_argument("--spacing-examples", type=int, default=0, help="print up to so many spacing errors of each file")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("folioframe-benchmark").getOrCreate()
    both = pairs(spark, a.data).persist()
    found = scores(both).persist()
    for r in found.orderBy("file").toLocalIterator():
        print(f"[{r['file']}] similarity {r['score']:.4f}, words {r['word_f1']:.4f}, headings {r['heading_f1']:.4f} ({r['heading_text_f1']:.4f}), split {r['n_split']}, glued {r['n_glued']}")
    if a.spacing_examples:
        for r in S.spacing_examples(both, a.spacing_examples).orderBy("file", "nth").toLocalIterator():
            print(f"[{r['file']}] {r['example']}")
    for r in S.rollup(found, metrics=("score", "word_f1", "heading_f1", "heading_text_f1")).orderBy(F.col("subset").isNull(), "subset").collect():  # a row for each subset
        print(f"{r['subset'] or 'all'}: {r['n_files']} files, similarity {r['mean_score']:.4f}, words {r['mean_word_f1']:.4f}, headings {r['mean_heading_f1']:.4f} ({r['mean_heading_text_f1']:.4f}), worst {r['worst_file']}")
    if a.output:
        from .operators.sinks import write_markdown

        write_markdown(both.select(F.col("file").alias("doc_id"), F.col("gen").alias("md")), a.output)
    if a.update_baseline:
        entries = {r["file"]: r["score"] for r in found.select("file", "score").toLocalIterator()}
        if not entries:
            print("no scores to write", file=sys.stderr)
            return 1
        with open(a.baseline, "w") as f:
            json.dump({"dataset": os.path.basename(a.data.rstrip("/")), "tool": "folioframe", "scores": dict(sorted(entries.items()))}, f, indent=2)
        return 0
    if not os.path.isfile(a.baseline):
        return 0
    worse = S.regressions(S.read_baseline(spark, a.baseline), found.select("file", "score"), a.tolerance).orderBy("file").collect()
    for r in worse:
        print(f"worse: {r['file']}: {r['want']} before, {r['got']} now", file=sys.stderr)
    return 1 if worse else 0


if __name__ == "__main__":
    sys.exit(main())
