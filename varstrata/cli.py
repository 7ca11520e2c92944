"""Command line: python -m varstrata.cli pack|unpack|ls|cat."""

from __future__ import annotations

import argparse
import contextlib
import resource
import sys
import time

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varstrata import errors
from varstrata.api import WIRE_ENDING, container
from varstrata.files import place
from varstrata.functions.scalars import parse_size
from varstrata.functions.scalars import recommended_block_size as recommended
from varstrata.limits import MIB, Limits, WrapperLimits
from varstrata.operators import blocks, inspect, project, wrappers
from varstrata.session import setting
from varstrata.sources import archive, text, wire_source

def session() -> SparkSession:
    spark = SparkSession.builder.appName("varstrata").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def opened(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Records of a file of the interchange format, by its ending, or of a native archive."""
    return wire_source.read(spark, path, fields) if path.endswith(WIRE_ENDING) else archive.read(spark, path)


class Summary:
    """What a command did and took, on standard error: records, records and MiB a second, the driver's peak memory."""

    def __init__(self, shown: bool):
        self.shown, self.began = shown, time.perf_counter()

    def step(self, text: str) -> None:
        if self.shown:
            print(f"{time.perf_counter() - self.began:6.1f} s  {text}", file=sys.stderr, flush=True)

    def end(self, records: int, n: int | None = None) -> None:
        took = max(time.perf_counter() - self.began, 1e-9)
        rate = "" if n is None else f", {n / took / MIB:.1f} MiB/s"
        self.step(f"{records} records, {records / took:.0f}/s{rate}; peak {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10} MiB on the driver")


def pack(spark: SparkSession, a: argparse.Namespace) -> None:
    told = Summary(a.verbose)
    limits = WrapperLimits(depth=int(setting("wrapper.depth", spark, a.wrapper_depth)), buffer_bytes=parse_size(str(setting("wrapper.buffer", spark, a.wrapper_buffer))))
    wrapped = {"pointer_at": a.wrapper_pointer, "section_specs": a.wrapper_sections, "map_at": a.wrapper_map, "headers": a.wrapper_array_headers}
    if any(v not in (None, False, []) for v in wrapped.values()):
        options = {}
        if a.wrapper_sections:
            options = {"label_field": None if a.wrapper_no_label else a.wrapper_label_field, "required": a.wrapper_sections_required}
        elif a.wrapper_map is not None:
            options = {"key_field": a.wrapper_key_field, "overwrite": a.wrapper_key_overwrite}
        records, hint = wrappers.apply(text.read_whole(spark, a.input), **wrapped, limits=limits, **options), "json_array"
    else:
        records, hint = text.read_auto(spark, a.input, a.ndjson, a.json_array)
    target = int(setting("block.records", spark, a.block_records))
    Limits(records_per_block=target)
    level = int(setting("zstd.level", spark, a.zstd_level))
    told.step(f"reading {a.input} as {hint}")
    if a.greedy:
        cut = blocks.greedy(records, target, Limits(segment_bytes=parse_size(a.segment_bytes)) if a.segment_bytes else Limits())
        cut = cut.withColumn("block_idx", F.when(F.col("error").isNull(), F.col("block_idx")).otherwise(F.raise_error("error").cast("long")))
        records = records.join(cut.drop("error", "cut_by"), ["src", "record_idx"])
    else:
        records = blocks.by_count(records, target)
    if a.output.endswith(WIRE_ENDING):
        wire_source.write(records, a.output, hint=hint, level=level, canonicalKeys=a.canonicalize_keys, canonicalNumbers=a.canonicalize_numbers, blockRecords=target, index=not a.no_index)
    else:
        archive.write(records, a.output, target, level, hint, canonical_numbers=a.canonicalize_numbers)
    if a.verbose:
        told.step(f"written to {a.output}")
        told.end(opened(spark, a.output).count(), bytes_at(a.input))


def bytes_at(path: str) -> int | None:
    """Bytes of a file, or of the files of a folder."""
    fs, at = place(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return info.size
    return sum(x.size for x in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if x.type == pafs.FileType.File) if info.type == pafs.FileType.Directory else None


def unpack(spark: SparkSession, a: argparse.Namespace) -> None:
    told = Summary(a.verbose)
    style = project.resolve_format(a.format, container(spark, a.input))
    told.step(f"writing {style}")
    with open(a.output, "w", encoding="utf-8") if a.output else contextlib.nullcontext(sys.stdout) as out:
        n = project.write_stream(project.ndjson_lines(opened(spark, a.input)), out, style)
    told.end(n, bytes_at(a.output) if a.output else None)


def ls(spark: SparkSession, a: argparse.Namespace) -> None:
    """Of the interchange format, block headers are read alone, unless statistics of the values are asked for."""
    wired = a.input.endswith(WIRE_ENDING)
    stats = inspect.field_stats(opened(spark, a.input), a.stats_sample) if a.stats else None
    if wired:
        parts = wire_source.describe(spark, a.input).persist()
        sizes = spark.createDataFrame([(k + 1, n) for k, (_, _, n) in enumerate(wire_source.block_table(a.input))], "block long, record_count long")
        summary = sizes.join(parts.groupBy("block").agg(F.count("*").alias("field_count")), "block", "left").select("block", "record_count", F.coalesce("field_count", F.lit(0)).alias("field_count"))
        directory = parts.select("block", "field", "present_count")
    else:
        records = opened(spark, a.input)
        summary, directory = inspect.blocks(records), inspect.field_directory(records)
    print(inspect.render(summary, stats, a.format, a.fields_only, a.blocks_only, a.verbose, a.stats_sample, directory), end="" if a.format == "table" else "\n")
    if wired:
        if a.verbose and (largest := parts.agg(F.max("uncompressed")).first()[0]):
            total = sizes.agg(F.sum("record_count")).first()[0]
            print(f"recommended block size: {recommended(total, Limits().segment_bytes, largest)} records", file=sys.stderr)
        parts.unpersist()


def cat(spark: SparkSession, a: argparse.Namespace) -> None:
    """Of the interchange format, headers tell the fields and the blocks; only the asked field of the asked blocks is
    unpacked."""
    if a.input.endswith(WIRE_ENDING):
        names = wire_source.describe(spark, a.input).select("field").distinct()
        inspect.require_field(names, a.field)
        low, high = inspect.parse_range(a.blocks, len(wire_source.block_table(a.input))) if a.blocks else (1, None)
        records = wire_source.read(spark, a.input, [a.field], firstBlock=low - 1, **({} if high is None else {"lastBlock": high - 1}))
    else:
        records = opened(spark, a.input)
        inspect.require_field(inspect.fields(records), a.field)
        if a.blocks:
            records = inspect.block_range(records, *inspect.parse_range(a.blocks, archive.manifest(spark, a.input).agg(F.max("block_idx")).first()[0] + 1))
    lines = project.values(records, a.field).select("src", "record_idx", project.value_text(F.col("value"), a.format).alias("line"))
    project.write_stream(lines, sys.stdout, "json_array" if a.format == "json_array" else "ndjson", a.field if a.format == "csv" and a.header else None)
    if a.format == "json_array":
        print()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="varstrata", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    x = sub.add_parser("pack")
    x.add_argument("input")
    x.add_argument("-o", "--output", required=True)
    form = x.add_mutually_exclusive_group()
    form.add_argument("--ndjson", action="store_true")
    form.add_argument("--json-array", action="store_true")
    mode = x.add_mutually_exclusive_group()
    mode.add_argument("--wrapper-pointer")
    mode.add_argument("--wrapper-sections", nargs="+")
    mode.add_argument("--wrapper-map", nargs="?", const="")
    mode.add_argument("--wrapper-array-headers", action="store_true")
    x.add_argument("--wrapper-label-field", default="_section")
    x.add_argument("--wrapper-no-label", action="store_true")
    x.add_argument("--wrapper-sections-required", action="store_true")
    x.add_argument("--wrapper-key-field", default="_key")
    x.add_argument("--wrapper-key-overwrite", action="store_true")
    x.add_argument("--wrapper-depth", "--wrapper-pointer-depth", type=int)
    x.add_argument("--wrapper-buffer", "--wrapper-pointer-buffer")
    x.add_argument("--block-records", type=int)
    x.add_argument("--greedy", action="store_true", help="also cut blocks at their size and at segment limits")
    x.add_argument("--segment-bytes")
    x.add_argument("--zstd-level", type=int)
    x.add_argument("--canonicalize-keys", action="store_true")
    x.add_argument("--canonicalize-numbers", action="store_true")
    x.add_argument("--no-index", action="store_true")
    x.add_argument("--verbose", action="store_true")
    x.set_defaults(run=pack)
    x = sub.add_parser("unpack")
    x.add_argument("input")
    x.add_argument("-o", "--output")
    x.add_argument("--format", choices=["auto", "ndjson", "json_array"], default="auto")
    x.add_argument("--verbose", action="store_true")
    x.set_defaults(run=unpack)
    x = sub.add_parser("ls")
    x.add_argument("input")
    x.add_argument("--format", choices=["table", "json"], default="table")
    x.add_argument("--stats", action="store_true")
    x.add_argument("--stats-sample", type=int, default=inspect.SAMPLE)
    only = x.add_mutually_exclusive_group()
    only.add_argument("--fields-only", action="store_true")
    only.add_argument("--blocks-only", action="store_true")
    x.add_argument("--verbose", action="store_true")
    x.set_defaults(run=ls)
    x = sub.add_parser("cat")
    x.add_argument("input")
    x.add_argument("--field", required=True)
    x.add_argument("--blocks")
    x.add_argument("--format", choices=["ndjson", "json_array", "csv"], default="ndjson")
    x.add_argument("--header", action="store_true")
    x.set_defaults(run=cat)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        a.run(session(), a)
    except Exception as e:  # noqa: BLE001  what isn't ours is raised again
        ours = errors.translate(e)
        if not isinstance(ours, errors.RecordError):
            raise
        print(f"error: {ours}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
