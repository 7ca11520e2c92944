"""The native archive: records as VARIANT in Parquet with Zstandard, laid out by source and block, and a manifest.

Readers get what Spark does for Parquet: only the fields of a record that a query names are read, blocks outside of a
range are skipped by statistics, and every file splits. The manifest is a table of its own, so that block counts are
read without touching records.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varstrata.operators.blocks import TARGET, by_count
from varstrata.session import prepare

SCHEMA = "src string, block_idx long, record_idx long, rec variant, part string"


def _laid(rows: DataFrame, part: str) -> DataFrame:
    """Ranges of blocks go to different tasks; the shuffle is by range, so neighbours stay together and statistics are
    tight."""
    laid = rows.select(F.lit(part).alias("part"), "src", "block_idx", "record_idx", "rec")
    return laid.repartitionByRange("src", "block_idx").sortWithinPartitions("part", "src", "record_idx")


def _store(rows: DataFrame, path: str, part: str, level: int, hint: str, overwrite: str) -> None:
    """Replaces what the archive holds of one part (overwrite: dynamic), or all that it holds (static). The manifest is
    made of the records as written, and comes last."""

    def put(df: DataFrame, to: str, **options) -> None:
        w = df.write.mode("overwrite").option("partitionOverwriteMode", overwrite)
        for k, v in options.items():
            w = w.option(k, v)
        w.partitionBy("part").parquet(f"{path}/{to}")

    put(_laid(rows, part), "records", **{"compression": "zstd", "parquet.compression.codec.zstd.level": str(level)})
    kept = rows.sparkSession.read.schema(SCHEMA).parquet(f"{path}/records").where(F.col("part") == part)
    put(kept.groupBy("src", "block_idx").agg(F.count("*").alias("record_count"), F.min("record_idx").alias("first_idx")).withColumn("container_format", F.lit(hint)).withColumn("part", F.lit(part)).coalesce(1), "manifest")


def write(records: DataFrame, path: str, target: int = TARGET, level: int = 6, hint: str = "unknown", canonical_numbers: bool = False) -> None:
    """A new archive of records, with or without block_idx, instead of what is at path."""
    rows = records if "block_idx" in records.columns else by_count(records, target)
    if canonical_numbers:
        rows = rows.withColumn("rec", F.parse_json(F.to_json("rec")))
    _store(rows, path, "all", level, hint, "static")


def append(records: DataFrame, path: str, part: str, level: int = 6, hint: str = "unknown") -> None:
    """Adds complete blocks as a part of their own, without reading what is there. A part that is there already is
    replaced, so that an append which failed half-way can be repeated."""
    if not re.fullmatch("[A-Za-z0-9_-]+", part) or part == "all":
        raise ValueError(f"not a name of a part: {part!r}")
    _store(records, path, part, level, hint, "dynamic")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(src, block_idx, record_idx, rec), in no particular order; order by src and record_idx where it matters."""
    return prepare(spark).read.schema(SCHEMA).parquet(f"{path}/records").drop("part")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src string, block_idx long, record_count long, first_idx long, container_format string, part string").parquet(f"{path}/manifest").drop("part")


def container_hint(spark: SparkSession, path: str) -> str:
    """The container that the records came from; unknown if sources differ."""
    found = [r[0] for r in manifest(spark, path).select("container_format").distinct().limit(2).collect()]
    return found[0] if len(found) == 1 else "unknown"
