"""Connected components of links between ids, kept in tables: neither links nor labels ever reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, paths_of, written

#: A graph of up to so many links is solved in one task.
FEW_LINKS = 10_000


def united(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, label of all links of one task."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for batch in rows:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([top(x) for x in above], pa.int64())], ["v", "label"])


def components(links: DataFrame, most_rounds: int = 60, few: int = FEW_LINKS, drop: bool = False) -> DataFrame:
    """links: a, b (long), a written table. Gives v, label: the smallest id that v is linked to, over any number of steps; ids without links are absent.

    Each round takes the smallest label among a node's neighbours, then jumps to the label's label, so a chain of n nodes
    needs some log(n) rounds. Neighbours are reduced with min before the shuffle, and joins by a hot node are split by AQE.
    """
    if links.limit(few + 1).count() <= few:
        labels = written(links.select("a", "b").coalesce(1).mapInArrow(united, "v long, label long"), "cc-labels")
        for p in paths_of(links) if drop else ():
            drop_path(links.sparkSession, p)
        return labels
    both = written(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "cc-links")
    links_at = paths_of(both)
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "cc-labels")
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("v", "a"), "a").groupBy("b").agg(F.min("label").alias("n")).withColumnRenamed("b", "v")
        low = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "n").alias("label"))
        # the label's own label, where that is smaller; few nodes are labels, so this side is reduced first
        roots = labels.select(F.col("v").alias("label"), F.col("label").alias("root"))
        new = written(low.join(roots, "label").select("v", "old", F.least("label", "root").alias("label")), "cc-labels")
        changed = new.filter("label <> old").limit(1).count()
        for p in paths_of(labels):
            drop_path(labels.sparkSession, p)
        labels = new.select("v", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"components: more than {most_rounds} rounds")
    for p in [*links_at, *(paths_of(links) if drop else ())]:
        drop_path(links.sparkSession, p)
    return labels
