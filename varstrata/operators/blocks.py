"""Blocks: which records are encoded together, and how large a column of a block gets."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrata.files import place
from varstrata.functions.scalars import string_length, uleb_length, zigzag
from varstrata.functions.tags import tag, tag_of
from varstrata.limits import Limits
from varstrata.model import cells
from varstrata.scratch import scratch
from varstrata.shipping import ship

TARGET = 100_000


def by_count(records: DataFrame, target: int = TARGET) -> DataFrame:
    """records with block_idx, from 0: target records to a block."""
    return records.withColumn("block_idx", F.floor(F.col("record_idx") / target).cast("long"))


#: What counts in a record's JSON: strings (keys too), openings, booleans, numbers.
_PARTS = r'"(?:[^"\\]|\\.)*"|[\[{]|true|false|-?[0-9][0-9.eE+-]*'


def memory(rec: Column) -> Column:
    """Estimate of a record's size: the bytes of its keys and strings, one for a boolean, the text's length for a number,
    nothing for a null, and eight for every array and object within."""
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"\\u[0-9a-fA-F]{4}", "x"), r"\\.", "x")
    one = lambda x: F.when(x.startswith('"'), F.octet_length(plain(x)) - 2).when(x.isin("[", "{"), 8).when(x.isin("true", "false"), 1).otherwise(F.length(x))
    return F.aggregate(F.regexp_extract_all(F.to_json(rec), F.lit(_PARTS), 0), F.lit(-8).cast("long"), lambda n, x: n + one(x))


def payload(v: Column, t: Column | None = None) -> Column:
    """Bytes of a value as its column holds it, if no dictionary is used: none for nulls and booleans, which are bits.
    t: the value's tag, if it is known."""
    t, text = tag(v) if t is None else t, F.to_json(v)
    digits = F.length(F.regexp_replace(F.regexp_replace(text, "[eE].*$", ""), "[^0-9]", ""))
    return (
        F.when(t == "int", uleb_length(zigzag(v.cast("long"))))
        .when(t == "decimal", 2 + uleb_length(digits.cast("long")) + digits)
        .when(t == "string", string_length(F.variant_get(v, "$", "string")))
        .when(t.isin("object", "array"), string_length(text))
        .otherwise(0)
    )


def segment_sizes(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, field, size): upper bound of each column's encoded bytes: presence, tags, and values as if no dictionary
    were used. blocks carries block_idx and records_in_block, the number of its records."""
    keys = ["src", "block_idx"] if keys is None else keys
    rows = cells(blocks, [*keys, "records_in_block", "record_idx"])
    total = F.ceil(F.max("records_in_block") / 8) + F.ceil(3 * F.count("*") / 8) + F.ceil(F.count(F.when(tag(F.col("value")) == "bool", 1)) / 8) + F.sum(payload(F.col("value")))
    return rows.groupBy(*keys, "field").agg(total.cast("long").alias("size"))


class Cutter:
    """Cuts a source's records into blocks, one after the other: at a number of records, at a size of the whole, and
    before any column would outgrow its segment."""

    def __init__(self, target: int, limits: Limits):
        self.target, self.limits = target, limits
        self.block, self.flushes, self.rejected = 0, {}, {}
        self.reason: str | None = None  # why the last record's block ended before that record
        self._new()

    def _new(self) -> None:
        self.n, self.bytes, self.columns = 0, 0, {}

    def _sizes(self, fields: list[tuple[str, int, bool]]) -> dict[str, tuple[int, int, int]]:
        out = {}
        for k, n, flag in fields:
            before = self.columns.get(k, (0, 0, 0))
            out[k] = (before[0] + n, before[1] + 1, before[2] + flag)
        return out

    def _full(self, sizes: dict) -> str | None:
        bits = lambda n: -(-n // 8)
        return next((k for k, (p, n, f) in sizes.items() if p + bits(self.n + 1) + bits(3 * n) + bits(f) > self.limits.segment_bytes), None)

    def add(self, fields: list[tuple[str, int, bool]], weight: int) -> int | str:
        """The record's block, or the name of the field that no block can take. fields: name, payload, whether it is a
        boolean; weight: the whole record's estimate."""
        sizes = self._sizes(fields)
        self.reason = None
        if (field := self._full(sizes)) and self.n:
            self.flushes[field] = self.flushes.get(field, 0) + 1
            self.reason = field
            self.block += 1
            self._new()
            sizes = self._sizes(fields)
            field = self._full(sizes)
        if field:
            self.rejected[field] = self.rejected.get(field, 0) + 1
            return field
        self.columns |= sizes
        self.n += 1
        self.bytes += weight
        here = self.block
        if self.n >= self.target or self.bytes >= self.limits.block_bytes:
            self.block += 1
            self._new()
        return here


class Run:
    """What Cutter does, over stretches of consecutive records of one source: where a block ends is searched for in sums
    over the stretch, field by field, and not looked at record by record."""

    def __init__(self, target: int, limits: Limits):
        self.target, self.limits = max(1, target), limits
        self.block = 0
        self._new()

    def _new(self) -> None:
        self.n, self.bytes, self.columns = 0, 0, {}

    def cut(self, weights: np.ndarray, ends: np.ndarray, names: pa.Array, sizes: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, dict[int, str], dict[int, str]]:
        """Block of each record; the field that ended the block before it; the field for which no block takes it. Fields
        of record i stand from ends[i] to ends[i + 1] in names, sizes and flags."""
        n = len(weights)
        found, reasons, refused = np.empty(n, np.int64), {}, {}
        heavy = np.concatenate(([0], np.cumsum(weights)))
        coded = names.dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        record = np.repeat(np.arange(n), np.diff(ends))
        order = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[order], np.arange(len(words) + 1)).tolist()
        columns = []
        for k, word in enumerate(words):
            own = order[bounds[k] : bounds[k + 1]]
            columns.append([word, record[own].tolist(), [0, *np.cumsum(sizes[own]).tolist()], [0, *np.cumsum(flags[own], dtype=np.int64).tolist()], 0])
        limit, i = self.limits.segment_bytes, 0
        while i < n:
            full_at, fields = n, []
            last = min(n - 1, i + self.target - self.n - 1)  # the block ends after this record at the latest
            if heavy[n] - heavy[i] + self.bytes >= self.limits.block_bytes:
                last = min(last, max(i, int(np.searchsorted(heavy, self.limits.block_bytes - self.bytes + heavy[i])) - 1))
            for column in columns:
                word, at, size, flag, low = column
                low = column[4] = bisect_left(at, i, low)
                high = bisect_right(at, last, low)
                before = self.columns.get(word, (0, 0, 0))
                p, f = before[0] - size[low], before[2] - flag[low]

                def full(t, at=at, size=size, flag=flag, low=low, p=p, c=before[1] + 1 - low, f=f, shift=self.n - i + 1):
                    return p + size[t + 1] + -(-(at[t] + shift) // 8) + -(-3 * (t + c) // 8) + -(-(f + flag[t + 1]) // 8) > limit

                if high > low and full(high - 1):
                    t = bisect_left(range(low, high), True, key=full) + low
                    if at[t] < full_at:
                        full_at, fields = at[t], [word]
                    elif at[t] == full_at:
                        fields.append(word)
            if full_at == n:
                found[i : last + 1] = self.block
                closes = self.n + last + 1 - i >= self.target or self.bytes + heavy[last + 1] - heavy[i] >= self.limits.block_bytes
                if closes:
                    self.block += 1
                    self._new()
                else:  # the stretch is at its end
                    for word, at, size, flag, low in columns:
                        a, b, c = self.columns.get(word, (0, 0, 0))
                        if len(at) > low:
                            self.columns[word] = (a + size[-1] - size[low], b + len(at) - low, c + flag[-1] - flag[low])
                    self.n, self.bytes = self.n + n - i, self.bytes + int(heavy[n] - heavy[i])
                i = last + 1
                continue
            if len(fields) > 1:
                own = [words[k] for k in code[ends[full_at] : ends[full_at + 1]].tolist()]
                fields = [w for w in own if w in fields]
            found[i:full_at] = self.block
            if full_at > i or self.n:
                reasons[full_at] = fields[0]
                self.block += 1
                self._new()
                i = full_at
            else:
                refused[i], found[i] = fields[0], -1
                i += 1
        return found, reasons, refused


#: Records whose sizes are looked at together; records that a task sorts.
STRETCH, RANGE = 100_000, 200_000


def greedy(records: DataFrame, target: int = TARGET, limits: Limits = Limits()) -> DataFrame:
    """(src, record_idx, block_idx, cut_by, error): blocks by number, size and segment limits. cut_by names the field
    whose segment would have grown too large, at the first record of the block that was begun instead.

    Where a block ends depends on all records before it, so each source is cut by one task, as a stream in the order of
    record_idx. It sorts and gathers nothing: many tasks sort ranges of (src, record_idx) and write numbers alone, the
    sizes of the records' fields; a task then reads the sources that begin in its range, and the ranges after it up to
    the end of the last of them.
    """
    spark = records.sparkSession
    ship(spark)
    # A step for each use of a value's tag, as lambdas work out again what they name twice.
    fields = F.transform(F.map_entries(F.col("rec").cast("map<string,variant>")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"), F.schema_of_variant(e["value"]).alias("s")))
    fields = F.transform(fields, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"), tag_of(e["s"]).alias("t")))
    fields = F.transform(fields, lambda e: F.struct(e["k"].alias("k"), payload(e["v"], e["t"]).cast("long").alias("n"), (e["t"] == "bool").alias("flag")))
    # Dealt before sizes are found, because dealing by ranges looks at its rows twice.
    # Their number goes by the records', as small shuffles would else be joined into ranges that grow.
    n = max(spark.sparkContext.defaultParallelism, -(-records.count() // RANGE))
    rows = records.select("src", "record_idx", "rec").repartitionByRange(n, "src", "record_idx")
    rows = rows.select("src", "record_idx", memory(F.col("rec")).cast("long").alias("weight"), F.octet_length(F.to_json("rec")).alias("bytes"), fields.alias("fields")).sortWithinPartitions("src", "record_idx")
    path = scratch(spark, "sizes")
    rows.write.option("parquet.block.size", 8 << 20).parquet(path)
    held = spark.read.parquet(path)
    # Numbers of range partitions stand in the names of their files.
    named = held.select("src", "record_idx", F.col("_metadata.file_path").alias("path"))
    ranges = sorted((int(r["path"].rpartition("/")[2].split("-")[1]), r["path"], r["low"], r["high"]) for r in named.groupBy("path").agg(F.min("src").alias("low"), F.max("src").alias("high")).collect())
    files = [(path, low, high) for _, path, low, high in ranges]
    schema = pa.schema([("src", pa.string()), ("record_idx", pa.int64()), ("block_idx", pa.int64()), ("cut_by", pa.string()), ("error", pa.string())])

    def cut(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                yield from of(k)

    def of(k: int):
        # A source that the file before holds too was begun by another task.
        foreign = files[k - 1][2] if k and files[k - 1][2] == files[k][1] else None
        src, run = None, None
        for name, low, _ in files[k:]:
            if name != files[k][0] and (low != src or src == foreign):
                return
            fs, at = place(name)
            with fs.open_input_file(at) as f, pq.ParquetFile(f) as table:
                for b in table.iter_batches(STRETCH, use_threads=False):
                    b = b.combine_chunks() if hasattr(b, "combine_chunks") else b
                    s = b.column("src")
                    begins = [0, *(np.flatnonzero(pc.not_equal(s[1:], s[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(s)]
                    for low, high in zip(begins, begins[1:], strict=False):
                        one = s[low].as_py()
                        if one == foreign:
                            continue
                        if run is None or one != src:
                            if name != files[k][0]:
                                return
                            src, run = one, Run(target, limits)
                        yield stretch(b.slice(low, high - low), run)

    def stretch(b: pa.RecordBatch, run: Run) -> pa.RecordBatch:
        sizes = b.column("fields")
        ends = sizes.offsets.to_numpy() - sizes.offsets[0].as_py()
        names, n, flags = (c if k == 0 else c.to_numpy(zero_copy_only=False) for k, c in enumerate(sizes.flatten().flatten()))
        found, reasons, refused = run.cut(b.column("weight").to_numpy(), ends, names, n, flags)
        size = b.column("bytes")
        errors = {i: f"LimitExceeded: Field '{name}' of one record alone ({size[i].as_py()} bytes) outgrows the segment limit" for i, name in refused.items()}
        sparse = lambda some: pa.array([some.get(i) for i in range(len(found))] if some else pa.nulls(len(found), pa.string()), pa.string())
        return pa.RecordBatch.from_arrays([b.column("src").cast(pa.string()), b.column("record_idx"), pa.array(found, mask=found < 0), sparse(reasons), sparse(errors)], schema=schema)

    out = spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(cut, "src string, record_idx long, block_idx long, cut_by string, error string")
    # Dealt again, as what follows may sort, and a large source comes from one task.
    return out.repartition(n, "src", F.coalesce("block_idx", "record_idx"))


def flush_metrics(cut: DataFrame) -> DataFrame:
    """(field, flushes, rejections) of what greedy() gives: how often a field ended a block early, and how many records
    no block could take because of it."""
    lost = F.regexp_extract("error", "Field '(.*)' of one record", 1)
    rows = cut.select(F.col("cut_by").alias("field"), F.lit(1).alias("f"), F.lit(0).alias("r")).where("field is not null")
    rows = rows.unionByName(cut.where("error is not null").select(lost.alias("field"), F.lit(0).alias("f"), F.lit(1).alias("r")))
    return rows.groupBy("field").agg(F.sum("f").alias("flushes"), F.sum("r").alias("rejections"))
