"""Whole jobs in one call: what the command line does, for programs."""

from __future__ import annotations

from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from varstrata.operators import blocks, project
from varstrata.sources import archive, text, wire_source

WIRE_ENDING = ".arc"


def compress(spark: SparkSession, source: str | DataFrame, target: str, block_records: int = blocks.TARGET, hint: str | None = None, **options) -> None:
    """Packs a file of JSON, or records, into a native archive or (by the ending of target) a file of the interchange
    format."""
    records, seen = text.read_auto(spark, source) if isinstance(source, str) else (source, "unknown")
    cut = blocks.by_count(records, block_records)
    if target.endswith(WIRE_ENDING):
        wire_source.write(cut, target, hint=hint or seen, blockRecords=block_records, **options)
    else:
        archive.write(cut, target, block_records, hint=hint or seen, **options)


def decompress(spark: SparkSession, path: str) -> DataFrame:
    """All records of an archive."""
    return wire_source.read(spark, path) if path.endswith(WIRE_ENDING) else archive.read(spark, path)


def container(spark: SparkSession, path: str) -> str:
    """The container that an archive's records came from."""
    if not path.endswith(WIRE_ENDING):
        return archive.container_hint(spark, path)
    with wire_source.File(path) as f:
        return f.header()[0].hint


def extract(spark: SparkSession, path: str, fields: list[str], out: TextIO, style: str = "auto", header: bool = True) -> int:
    """Writes some fields of all records, in order, as ndjson, json_array or csv; how many records there were."""
    records = wire_source.read(spark, path, fields) if path.endswith(WIRE_ENDING) else archive.read(spark, path)
    if style == "csv":
        return project.write_stream(project.csv_lines(records, fields), out, header=",".join(fields) if header else None)
    return project.write_stream(project.ndjson_lines(project.project(records, fields)), out, project.resolve_format(style, container(spark, path)))
