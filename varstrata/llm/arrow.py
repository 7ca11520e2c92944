"""Arrow batches of whole texts for the operators that run in Python."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are held as Python objects at once.
SLICE = 128


#: Bytes of an Arrow batch between Spark and Python, where the session says nothing else; long texts come few at a time.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_defaults: set[str] = set()


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and what one stage needed at its peak would
    stay with them through the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lent(body):
    """body for mapInArrow, giving memory back between batches and at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                del b
                give_back()

        try:
            yield from body(fed())
        finally:
            give_back()

    return run


def mapped(df: DataFrame, body, schema: str) -> DataFrame:
    """df.mapInArrow(body, schema), in batches of bounded size."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _defaults and _SETTING not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(_SETTING, str(BATCH_BYTES))
        _defaults.add(app)
    return df.mapInArrow(lent(body), schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Short slices, without copying, so that a batch of long texts isn't turned into Python objects all at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def mapper(body: Callable[[pa.RecordBatch], list], schema: pa.Schema, rows: int = SLICE):
    """A function for mapInArrow: body gets a slice and returns its columns, in the order of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, rows):
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(body(b), schema, strict=True)], schema=schema)

    return run


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
