"""Streams of JSON lines into a native archive, one complete set of blocks for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varstrata.model import numbered
from varstrata.operators.blocks import TARGET, by_count
from varstrata.session import prepare
from varstrata.sources import archive
from varstrata.sources.text import lines_of, parsed


def lines(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of (src, value) from the files that appear in a folder."""
    return prepare(spark).readStream.option("maxFilesPerTrigger", per_trigger).text(path).select(F.col("_metadata.file_path").alias("src"), "value")


def into_archive(stream: DataFrame, path: str, checkpoint: str, target: int = TARGET, lenient: bool = False, **trigger) -> StreamingQuery:
    """Appends each micro-batch as a source and a part named after it: a batch that is repeated after a failure replaces
    what the first try left. Blocks are complete within a batch; its last one may be shorter."""

    def add(batch: DataFrame, number: int) -> None:
        src = f"batch-{number:012d}"
        rows = lines_of(batch).withColumn("_k", F.monotonically_increasing_id())
        recs = numbered(rows.select(F.lit(src).alias("src"), F.col("src").alias("_file"), "_k", parsed(F.col("value"), lenient).alias("rec")).where(F.col("rec").isNotNull()), ["_file", "_k"])
        archive.append(by_count(recs.select("src", "record_idx", "rec"), target), path, src, hint="ndjson")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
