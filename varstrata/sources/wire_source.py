"""Spark's data source for files of the interchange format, short name "varstrata".

Reading: option path (a file, or several joined by commas); fields (a JSON list: only their segments are unpacked);
firstBlock and lastBlock (a range of block_idx: only its blocks are opened); mode PERMISSIVE (goes on at the next block
that can be found after a broken header); verifyChecksums; minPartitions; partitionBytes. Rows are (src, block_idx,
record_idx, json); blocks that follow each other share a partition, up to partitionBytes of packed blocks. Filters aren't pushed into the reader: Spark keeps a pushed filter for later queries of the same frame.

Writing: rows of (block_idx, record_idx, json), each block's rows together and in order within one partition, as
blocks_of() deals them. Tasks write their blocks to files of their own beside the target; the commit joins them by
block_idx, adds the index, and puts the file in place.
"""

from __future__ import annotations

import contextlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from varstrata import errors
from varstrata.files import place
from varstrata.limits import Limits
from varstrata.operators.blocks import flush_metrics
from varstrata.session import prepare
from varstrata.shipping import ship
from varstrata.sources import wire

NAME = "varstrata"
SCHEMA = "src string, block_idx long, record_idx long, json string"
_ARROW = pa.schema([("src", pa.string()), ("block_idx", pa.int64()), ("record_idx", pa.int64()), ("json", pa.string())])
CHUNK = 1 << 16
#: Packed bytes of the blocks that a task reads, unless one block has more; bytes that are copied at once.
PARTITION, COPIED = 1 << 20, 4 << 20
#: Files that are held open at once.
OPENED = 256


class File:
    """Random access to a file, on the driver for its headers and in tasks for one block each."""

    def __init__(self, path: str):
        self.path = path
        fs, at = place(path)
        self.f = fs.open_input_file(at)
        self.size = self.f.size()

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_) -> None:
        self.f.close()

    def bytes(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(max(0, min(n, self.size - at)))

    def header(self) -> tuple[wire.FileHeader, int]:
        head = self.bytes(0, CHUNK)
        while True:
            try:
                return wire.FileHeader.decode(head)
            except errors.UnexpectedEof:
                if len(head) == self.size:
                    raise
                head = self.bytes(0, 2 * len(head))

    def index(self) -> list[tuple[int, int, int]] | None:
        """None if there is no index, or it can't be read."""
        if self.size < 12:
            return None
        at = struct.unpack("<Q", self.bytes(self.size - 8, 8))[0]
        if not 0 < at < self.size - 8 or self.bytes(at, 4) != wire.INDEX_MAGIC:
            return None
        try:
            return wire.decode_index(self.bytes(at, self.size - 8 - at))
        except errors.RecordError:
            return None

    def block_header(self, at: int, limits: Limits) -> tuple[wire.BlockHeader, int]:
        n = CHUNK
        while True:
            data = self.bytes(at, n)
            try:
                return wire.BlockHeader.decode(data, 0, limits)
            except errors.UnexpectedEof:
                if at + len(data) >= self.size:
                    raise
                n *= 4

    def walk(self, at: int, lenient: bool, limits: Limits) -> Iterator[tuple[int, int, int]]:
        """Blocks one after the other, up to the index or the end. If lenient, what can't be read as a header is skipped
        up to the next place where a block begins."""
        while at < self.size:
            if self.bytes(at, 4) == wire.INDEX_MAGIC:
                return
            try:
                header, begin = self.block_header(at, limits)
                size = begin + header.packed + 4
                if at + size > self.size:
                    raise errors.UnexpectedEof("a block ends after the file")
                yield at, size, header.records
                at += size
            except errors.RecordError:
                if not lenient:
                    raise
                at = self.seek(at + 1)

    def seek(self, at: int) -> int:
        while at < self.size:
            data = self.bytes(at, CHUNK)
            if (found := data.find(wire.BLOCK_MAGIC)) >= 0:
                return at + found
            at += max(1, len(data) - 3)
        return self.size

    def blocks(self, lenient: bool, limits: Limits) -> list[tuple[int, int, int]]:
        header, at = self.header()
        found = self.index()
        if found is None:
            return list(self.walk(at, lenient, limits))
        for k, (offset, size, records) in enumerate(found):
            if offset < at or offset + size > self.size:
                raise errors.CorruptBlock(f"the index has block {k + 1} outside of the file")
        return found


@dataclass
class BlockPartition(InputPartition):
    """Blocks of one file: number, place, size, records, and how many records stand before each."""

    path: str
    blocks: list[tuple[int, int, int, int, int]]

    def __post_init__(self):
        super().__init__(self.path)


def limits_of(header: wire.FileHeader) -> Limits:
    """The default limits, with the segment limit that the writer noted."""
    own = header.segment_bytes
    return Limits(segment_bytes=own, block_bytes=max(own, Limits().block_bytes)) if own else Limits()


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        if not self.paths:
            raise errors.IoError("the option path is missing")
        self.fields = json.loads(options["fields"]) if options.get("fields") else None
        self.lenient = options.get("mode", "").upper() == "PERMISSIVE"
        self.verify = options.get("verifychecksums", "true").lower() != "false"
        self.low = int(options.get("firstblock", 0))
        self.high = int(options["lastblock"]) if options.get("lastblock") else None
        self.most = int(options["partitionbytes"]) if options.get("partitionbytes") else None
        self.least = int(options.get("minpartitions", 1))

    def partitions(self):
        found = []
        for path in self.paths:
            with File(path) as f:
                before = 0
                for k, (at, size, records) in enumerate(f.blocks(self.lenient, limits_of(f.header()[0]))):
                    if k >= self.low and (self.high is None or k <= self.high):
                        found.append((path, (k, at, size, records, before)))
                    before += records
        most = self.most or min(PARTITION, sum(block[2] for _, block in found) // self.least)
        out, room = [], 0
        for path, block in found:
            if not out or out[-1].path != path or room < block[2]:
                out.append(BlockPartition(path, []))
                room = most
            out[-1].blocks.append(block)
            room -= block[2]
        return out or [InputPartition(None)]

    def read(self, part):
        if not isinstance(part, BlockPartition):
            return
        with File(part.path) as f:
            limits = limits_of(f.header()[0])
            for block, at, size, records, before in part.blocks:
                rows = wire.decode_block(f.bytes(at, size), self.fields, self.verify, limits)
                if len(rows) != records:
                    raise errors.CorruptBlock("the index has another number of records than the block")
                for low in range(0, len(rows), 10_000):
                    some = rows[low : low + 10_000]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array([block] * n, pa.int64()), pa.array(range(before + low, before + low + n), pa.int64()), pa.array(some, pa.string())], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    path: str
    blocks: list[tuple[int, int, int, int]]  # block_idx, offset within the task's file, size, records


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.header = wire.FileHeader(level=int(options.get("level", 6)), compressor=wire.NONE if options.get("compression") == "none" else wire.ZSTD)
        self.header.with_hint(options.get("hint", "unknown"))
        self.header.flags |= wire.CANONICAL_KEYS * (options.get("canonicalkeys") == "true") | wire.CANONICAL_NUMBERS * (options.get("canonicalnumbers") == "true")
        self.header.block_hint = int(options.get("blockrecords", 0))
        self.limits = Limits(segment_bytes=int(options["segmentbytes"])) if options.get("segmentbytes") else Limits()
        if self.limits.segment_bytes != Limits().segment_bytes:
            self.header.metadata = json.dumps({wire.SEGMENT_KEY: self.limits.segment_bytes}).encode()
        self.index = options.get("index", "true") != "false"
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        path, blocks, offset = f"{self.path}.{self.job}.{uuid.uuid4().hex}.part", [], 0
        fs, at = place(path)
        with fs.open_output_stream(at) as out:

            def close(block: int, rows: list) -> None:
                nonlocal offset
                data = wire.encode_block(rows, self.header.compressor, self.header.level, bool(self.header.flags & wire.CANONICAL_KEYS), bool(self.header.flags & wire.CANONICAL_NUMBERS), self.limits)
                out.write(data)
                blocks.append((block, offset, len(data), len(rows)))
                offset += len(data)

            block, rows = None, []
            for batch in iterator:
                for own, text in zip(batch.column("block_idx").to_pylist(), batch.column("json").to_pylist(), strict=True):
                    if own != block and rows:
                        close(block, rows)
                        rows = []
                    block = own
                    rows.append(wire.loads(text))
            if rows:
                close(block, rows)
        return Written(path, blocks)

    def commit(self, messages):
        done = [m for m in messages if m]
        fs, target = place(self.path)
        if not self.overwrite and fs.get_file_info(target).type != pafs.FileType.NotFound:
            self.abort(messages)
            raise errors.IoError(f"{self.path} exists")
        order = sorted((*b, m.path) for m in done for b in m.blocks)
        if len({b[0] for b in order}) < len(order):
            self.abort(messages)
            raise errors.InternalError("a block was written by two tasks")
        index, made = [], f"{target}.{self.job}"
        with fs.open_output_stream(made) as out:
            head = self.header.encode()
            out.write(head)
            at = len(head)
            with contextlib.ExitStack() as opened:
                files: dict[str, File] = {}
                for _, offset, size, records, path in order:
                    if path not in files:
                        if len(files) == OPENED:
                            opened.close()
                            files.clear()
                        files[path] = opened.enter_context(File(path))
                    out.write(files[path].bytes(offset, size))
                    index.append((at, size, records))
                    at += size
            if index and self.index:
                out.write(wire.encode_index(index) + struct.pack("<Q", at))
        fs.move(made, target)
        self.abort(messages)

    def abort(self, messages):
        for m in messages:
            if m:
                fs, at = place(m.path)
                fs.delete_file(at)


class Source(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)


def enable(spark: SparkSession) -> SparkSession:
    """Registers the format with a session."""
    ship(spark)
    spark.dataSource.register(Source)
    return prepare(spark)


def read(spark: SparkSession, path: str, fields: list[str] | None = None, **options) -> DataFrame:
    """(src, block_idx, record_idx, rec)."""
    r = enable(spark).read.format(NAME).option("path", path).option("minPartitions", spark.sparkContext.defaultParallelism)
    if fields is not None:
        r = r.option("fields", json.dumps(fields))
    for k, v in options.items():
        r = r.option(k, str(v).lower() if isinstance(v, bool) else v)
    return r.load().select("src", "block_idx", "record_idx", F.parse_json("json").alias("rec"))


def blocks_of(records: DataFrame) -> DataFrame:
    """(block_idx, record_idx, json) dealt so that each block lies in one partition, in order."""
    rows = records.select("block_idx", "record_idx", F.to_json("rec").alias("json"))
    return rows.repartition("block_idx").sortWithinPartitions("block_idx", "record_idx")


def write(records: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """Records with block_idx to one file."""
    enable(records.sparkSession)
    w = blocks_of(records).write.format(NAME).mode(mode).option("path", path)
    for k, v in options.items():
        w = w.option(k, str(v).lower() if isinstance(v, bool) else v)
    w.save()


def block_table(path: str) -> list[tuple[int, int, int]]:
    """(offset, size, records) of a file's blocks: from its index, or from the headers alone."""
    with File(path) as f:
        return f.blocks(False, limits_of(f.header()[0]))


def describe(spark: SparkSession, path: str) -> DataFrame:
    """(block, field, records, present_count, flags, dict_entries, compressed, uncompressed): the directories of a file,
    from its headers alone, which tasks read side by side."""
    ship(spark)
    blocks = spark.createDataFrame([(k + 1, at) for k, (at, _, _) in enumerate(block_table(path))], "block long, at long")
    schema = pa.schema([("block", pa.int64()), ("field", pa.string()), *((c, pa.int64()) for c in ("records", "present_count", "flags", "dict_entries", "compressed", "uncompressed"))])

    def run(batches):
        with File(path) as f:
            limits = limits_of(f.header()[0])
            for b in batches:
                rows = []
                for k, at in zip(b.column("block").to_pylist(), b.column("at").to_pylist(), strict=True):
                    header, _ = f.block_header(at, limits)
                    rows += [(k, s.name, header.records, s.present, s.flags, s.entries, s.packed, s.raw) for s in header.segments]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return blocks.mapInArrow(run, "block long, field string, records long, present_count long, flags long, dict_entries long, compressed long, uncompressed long")


def writer_metrics(spark: SparkSession, path: str, cut: DataFrame | None = None) -> DataFrame:
    """(field, blocks, records, present, largest_segment, packed_bytes): what a file's writer made, by field. With what
    blocks.greedy() gave for it also flushes and rejections: blocks that the field ended early, records refused for it."""
    out = describe(spark, path).groupBy("field").agg(F.count("*").alias("blocks"), F.sum("records").alias("records"), F.sum("present_count").alias("present"), F.max("uncompressed").alias("largest_segment"), F.sum("compressed").alias("packed_bytes"))
    if cut is None:
        return out
    return out.join(flush_metrics(cut), "field", "full").fillna(0, ["flushes", "rejections"])
