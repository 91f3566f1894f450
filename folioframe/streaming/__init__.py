"""Documents that arrive as files: the same per-document plan, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.layout import to_markdown
from ..sources.pdf import scan

FILES = "path string, modificationTime timestamp, length long, content binary"


def markdown_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.pdf", **trigger) -> StreamingQuery:
    """Convert files as they appear in a folder. A document comes whole, so there is no state beyond the list of files seen.

    Each batch is written below batch=<number>, and a batch that is replayed replaces what it wrote before.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)

    def convert(batch: DataFrame, batch_id: int) -> None:
        done = to_markdown(scan.part(scan.scan(batch), "blocks")).withColumn("batch", F.lit(batch_id))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return files.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
