"""Projection and output of records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrata.errors import InternalError, UnsupportedFeature
from varstrata.files import place
from varstrata.functions.scalars import csv_cell
from varstrata.functions.tags import text
from varstrata.model import field
from varstrata.scratch import discard, made, scratch

MAP = "map<string,variant>"
#: Bytes of a part that are copied at once.
COPIED = 4 << 20


def project(records: DataFrame, fields: list[str]) -> DataFrame:
    """rec reduced to some fields: absent ones stay absent, nulls stay null, a record with none of them is {}."""
    if not fields:
        raise InternalError("a projection needs a field at least")
    names = F.array(*[F.lit(f) for f in fields])
    return records.withColumn("rec", F.to_variant_object(F.map_filter(F.col("rec").cast(MAP), lambda k, _: F.array_contains(names, k))))


def columns(records: DataFrame, fields: list[str]) -> DataFrame:
    """src, record_idx and a VARIANT column for each field: what Parquet scans can prune to."""
    if not fields:
        raise InternalError("a projection needs a field at least")
    return records.select("src", "record_idx", *[field(F.col("rec"), f).alias(f) for f in fields])


def csv_lines(records: DataFrame, fields: list[str]) -> DataFrame:
    """(src, record_idx, line): fields in the order asked for; null and absent are empty, nested values JSON."""
    cols = columns(records, [*dict.fromkeys(fields)])
    return cols.select("src", "record_idx", F.concat_ws(",", *[csv_cell(text(F.col(f"`{f}`"))) for f in fields]).alias("line"))


def ndjson_lines(records: DataFrame) -> DataFrame:
    return records.select("src", "record_idx", F.to_json("rec").alias("line"))


def values(records: DataFrame, name: str) -> DataFrame:
    """(src, record_idx, value): one field where it is present, JSON's null included."""
    v = records.select("src", "record_idx", field(F.col("rec"), name).alias("value"))
    return v.where(F.col("value").isNotNull())


def value_text(value: Column, style: str = "ndjson") -> Column:
    """A value as a line: JSON; or, in style csv, strings bare and without quotes, nulls as null."""
    if style == "csv":
        return F.when(F.to_json(value) == "null", F.lit("null")).otherwise(text(value))
    return F.to_json(value)


def resolve_format(asked: str, hint: str) -> str:
    """auto follows the container that was seen; an unknown one means NDJSON."""
    if hint == "reserved":
        raise UnsupportedFeature("the container hint 3 is reserved")
    return {"json_array": "json_array"}.get(hint, "ndjson") if asked == "auto" else asked


def _batch(lines) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], schema=pa.schema([("line", pa.string())]))


def _ordered(lines: DataFrame) -> DataFrame:
    """Lines that are equal in both are dealt by a hash, so that no task gets all of them."""
    return lines.repartitionByRange("src", "record_idx", F.xxhash64("line")).sortWithinPartitions("src", "record_idx").select("line")


def write_lines(lines: DataFrame, path: str, header: str | None = None, mode: str = "overwrite") -> None:
    """Lines as text files in the order of (src, record_idx), many at once and byte for byte; a header goes before the
    first line of every file that has lines."""

    def headed(batches):
        first = True
        for b in batches:
            if first and b.num_rows:
                yield _batch([header])
                first = False
            yield _batch(b.column("line"))

    rows = _ordered(lines)
    (rows if header is None else rows.mapInArrow(headed, "line string")).write.mode(mode).text(path)


def write_arrays(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lines of JSON as files in the order of (src, record_idx), each of them one JSON array with an element a line."""

    def bracketed(batches):
        held: list[str] = []
        for b in batches:
            if not b.num_rows:
                continue
            if held:
                yield _batch([x + "," for x in held])
                held = b.column("line").to_pylist()
            else:
                held = b.column("line").to_pylist()
                held[0] = "[" + held[0]
        if held:
            yield _batch([*(x + "," for x in held[:-1]), held[-1] + "]"])

    _ordered(lines).mapInArrow(bracketed, "line string").write.mode(mode).text(path)


def write_file(lines: DataFrame, path: str, array: bool = False) -> None:
    """Lines as one text file in the order of (src, record_idx), or as one JSON array with an element a line. Tasks sort
    and write parts side by side; the driver joins their bytes, and deletes each part as soon as it is copied."""
    with made() as tables:
        parts = scratch(lines.sparkSession, "parts")
        rows = _ordered(lines)
        (rows.select(F.concat("line", F.lit(",")).alias("line")) if array else rows).write.option("compression", "none").option("lineSep", "\n").text(parts)
        fs, at = place(parts)
        names = sorted((f.path for f in fs.get_file_info(FileSelector(at)) if f.base_name.startswith("part-")), key=lambda p: (int(p.rpartition("/")[2].split("-")[1]), p))
        to, target = place(path)
        # Of an array's last line the comma and the end of the line go.
        kept, tail = 2 * array, b""
        with to.open_output_stream(target, compression=None) as out:
            out.write(b"[" * array)
            for name in names:
                with fs.open_input_stream(name, compression=None) as f:
                    while data := f.read(COPIED):
                        data = tail + data
                        tail = data[len(data) - kept :]
                        out.write(data[: len(data) - kept])
                fs.delete_file(name)
            out.write(b"]\n" * array)
    discard(tables)


def json_array_text(lines: DataFrame) -> Iterator[str]:
    """The pieces of one JSON array, in order, one partition at a time on the driver: [a,b]."""
    yield "["
    for k, row in enumerate(lines.orderBy("src", "record_idx").select("line").toLocalIterator(prefetchPartitions=True)):
        yield ("," if k else "") + row["line"]
    yield "]"


def write_stream(lines: DataFrame, out, style: str = "ndjson", header: str | None = None) -> int:
    """Writes to any text stream; how many records were written."""
    n = 0
    if style == "json_array":
        for piece in json_array_text(lines):
            out.write(piece)
            n += piece not in "[]"
        return n
    if header is not None:
        out.write(header + "\n")
    for row in lines.orderBy("src", "record_idx").select("line").toLocalIterator(prefetchPartitions=True):
        out.write(row["line"] + "\n")
        n += 1
    return n
