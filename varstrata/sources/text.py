"""JSON text as records: NDJSON, JSON arrays, single objects, and what a file seems to be."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varstrata import errors
from varstrata.files import place
from varstrata.functions.tags import is_object, json_type, tag
from varstrata.session import prepare
from varstrata.shipping import ship

BOM = "﻿"
#: Bytes that are looked at to tell what a file holds; bytes that are split at once.
PEEK, CHUNK = 4096, 4 << 20
#: Files whose splits' counts are broadcast; those of more files are joined.
FEW_FILES = 100_000
#: Bytes of a large array that a task splits; bytes of elements that are handed on at once.
PART, BATCH = 32 << 20, 1 << 20
BLANK = b" \t\r\n"


def object_only(v: Column, what: str = "record") -> Column:
    return F.when(is_object(v), v).otherwise(F.raise_error(F.concat(F.lit(f"JsonError: {what} is not an object but "), F.coalesce(json_type(v), F.lit("nothing")))).cast("variant"))


def strict(value: Column, lenient: bool = False) -> Column:
    """The one JSON value that a text holds, as VARIANT. Anything but white space before or after it is an error, or NULL
    if lenient.

    parse_json leaves what follows the first value unread, so the text is parsed as the first element of an array whose
    second one is a number drawn for this plan: where that number isn't the second element, the text isn't one value.
    """
    mark = uuid.uuid4().int >> 66
    v = (F.try_parse_json if lenient else F.parse_json)(F.concat(F.lit("["), value, F.lit(f",{mark}]")))
    whole = F.try_variant_get(v, "$[1]", "long").eqNullSafe(F.lit(mark))
    first = F.variant_get(v, "$[0]", "variant")
    if lenient:
        return F.when(whole, first)
    return F.when(value.isNull(), F.lit(None).cast("variant")).when(whole, first).otherwise(F.raise_error(F.lit("JsonError: there is text after the value")).cast("variant"))


def parsed(value: Column, lenient: bool = False) -> Column:
    """A line's record. A bad line, or text after its object, is an error; if lenient it is NULL, as is what isn't an
    object."""
    v = strict(value, lenient)
    return F.when(is_object(v), v) if lenient else object_only(v)


def with_record(df: DataFrame, what: str = "record", lenient: bool = False) -> DataFrame:
    """df with rec, the record that value holds, as by parsed(). A projection for each step: expressions that name a step
    twice would parse the text twice."""
    mark, v = uuid.uuid4().int >> 66, F.col("_v")
    whole = F.try_variant_get(v, "$[1]", "long").eqNullSafe(F.lit(mark))
    first = F.when(whole, F.variant_get(v, "$[0]", "variant"))
    if not lenient:
        first = F.when(F.col("value").isNull(), F.lit(None).cast("variant")).when(whole, F.variant_get(v, "$[0]", "variant")).otherwise(F.raise_error(F.lit("JsonError: there is text after the value")).cast("variant"))
    df = df.withColumn("_v", (F.try_parse_json if lenient else F.parse_json)(F.concat(F.lit("["), "value", F.lit(f",{mark}]"))))
    df = df.withColumn("_v", first)
    return df.withColumn("rec", F.when(is_object(v), v) if lenient else object_only(v, what)).drop("_v")


def lines_of(df: DataFrame, value: str = "value") -> DataFrame:
    """Lines without a byte order mark at their start; blank ones go."""
    return df.withColumn(value, F.regexp_replace(value, f"^{BOM}", "")).where(F.length(F.trim(F.regexp_replace(value, r"\s", ""))) > 0)


def read_ndjson(spark: SparkSession, path, lenient: bool = False) -> DataFrame:
    """(src, record_idx, rec): one object per line of the files at path; src is the file.

    Files are split as Spark likes; a line's number is its place in its split plus the lines of the splits before it,
    counted by one narrow job and joined without dealing or sorting lines.
    """
    prepare(spark)
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("_at"))
    rows = lines_of(rows).withColumn("_m", F.monotonically_increasing_id())
    split = rows.groupBy("src", "_at").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    split = split.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("src").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    if len(rows.inputFiles()) <= FEW_FILES:
        split = F.broadcast(split)
    out = with_record(rows.join(split, ["src", "_at"]), lenient=lenient).select("src", (F.col("_before") + F.col("_m") - F.col("_first")).alias("record_idx"), "rec")
    return out.where(F.col("rec").isNotNull()) if lenient else out


def read_whole(spark: SparkSession, path) -> DataFrame:
    """(src, value): whole files as text, without a byte order mark."""
    prepare(spark)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("src"), F.regexp_replace("value", f"^{BOM}", "").alias("value"))


def array_records(docs: DataFrame) -> DataFrame:
    """Records of (src, value) whose text is an array of objects, or one object. Text after the value is an error. Whole
    texts are parsed at once, so they must fit into a VARIANT; read_json_array() splits files of any size."""
    v = F.when(F.length(F.trim(F.regexp_replace("value", r"\s", ""))) == 0, F.raise_error(F.lit("UnexpectedEof: the text is empty")).cast("variant")).otherwise(strict(F.col("value")))
    root = docs.select("src", v.alias("v"))
    kind = tag(F.col("v"))
    many = F.when(kind == "array", F.col("v").cast("array<variant>")).when(kind == "object", F.array("v"))
    many = many.otherwise(F.raise_error(F.concat(F.lit("TypeMismatch: an array or object is expected, found "), json_type(F.col("v")))).cast("array<variant>"))
    return root.select("src", F.posexplode(many).alias("record_idx", "rec")).select("src", F.col("record_idx").cast("long").alias("record_idx"), object_only(F.col("rec"), "element").alias("rec"))


#: What counts in JSON outside of values: quotes, openings, closings, commas.
_KIND = np.zeros(256, np.uint8)
_KIND[34], _KIND[[91, 123]], _KIND[[93, 125]], _KIND[44] = 1, 2, 3, 4
_STEP = np.array([0, 0, 1, -1, 0], np.int64)


def marks(b: np.ndarray, slashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places and kinds of the brackets, commas and quotes that no backslash escapes; how many of those quotes stand
    before or at each; how many backslashes end the bytes. slashes: how many stand just before them."""
    kinds = _KIND[b]
    at = np.flatnonzero(kinds)
    kind = kinds[at]
    quote = kind == 1
    ending = 0
    if slashes or (b == 92).any():
        plain = np.maximum.accumulate(np.where(b != 92, np.arange(len(b)), -1))
        quotes = at[quote]
        before = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1)
        run = quotes - 1 - before + np.where(before < 0, slashes, 0)
        kept = np.ones(len(at), bool)
        kept[quote] = run % 2 == 0
        at, kind, quote = at[kept], kind[kept], quote[kept]
        ending = int(len(b) - 1 - plain[-1]) + (slashes if plain[-1] < 0 else 0)
    return at, kind, np.cumsum(quote), ending


class Splitter:
    """Cuts the bytes of a JSON array into its elements, chunk by chunk: strings are told from structure by the parity
    of quotes that no backslash escapes, and elements by commas at depth one. What the elements hold isn't looked at."""

    def __init__(self):
        self.held: list[bytes] = []
        self.inside, self.depth, self.slashes, self.first = False, 0, 0, True
        self.state = "before"  # the root; then array, object or scalar; then done
        self.skip = False  # what comes up to the next cut belongs to an element that began before

    def feed(self, data: bytes) -> Iterator[bytes]:
        if self.state == "before":
            data = data.removeprefix(BOM.encode()).lstrip(BLANK)
            if not data:
                return
            self.state = {b"[": "array", b"{": "object"}.get(data[:1], "scalar")
        if self.state == "done":
            if data.strip(BLANK):
                raise errors.JsonError("there is text after the value")
            return
        b = np.frombuffer(data, np.uint8)
        at, kind, quotes, self.slashes = marks(b, self.slashes)
        free = ((quotes + self.inside) % 2 == 0) & (kind != 1)
        if len(quotes):
            self.inside = bool((quotes[-1] + self.inside) % 2)
        at, kind = at[free], kind[free]
        level = self.depth + np.cumsum(_STEP[kind])
        ends = at[(kind == 3) & (level == 0)]
        first = 0
        if self.state == "array":
            cuts = at[(kind == 4) & (level == 1)]
            if len(ends):
                if b[ends[0]] != 93:
                    raise errors.JsonError("an array ends in another bracket")
                cuts = np.append(cuts[cuts < ends[0]], ends[0])
            for cut in cuts.tolist():
                yield self.taken(data[first:cut], last=bool(len(ends)) and cut == ends[0])
                first = cut + 1
        elif self.state == "object" and len(ends):
            first = int(ends[0]) + 1
            yield self.taken(data[:first])
        if len(level):
            self.depth = int(level[-1])
        if len(ends) and self.state != "scalar":
            self.state, self.held = "done", []
            yield from self.feed(data[first:])
        elif not self.skip:
            self.held.append(data[first:])

    def taken(self, tail: bytes, last: bool = False) -> bytes:
        """The element that ends with tail. Only an array without elements may end in nothing."""
        if self.skip:
            self.skip = False
            return b""
        out, self.held = b"".join([*self.held, tail]), []
        if self.state == "array" and self.first:
            self.first, out = False, out[1:]
            if last and not out.strip(BLANK):
                return b""
        if not out.strip(BLANK):
            raise errors.JsonError("an element is missing between commas")
        return out

    def finish(self) -> bytes:
        """What is left at the end of the file: nothing, or a root that is neither array nor object."""
        if self.state == "scalar":
            return b"".join(self.held)
        if self.state != "done":
            raise errors.UnexpectedEof("the text is empty" if self.state == "before" else "the text ends within its value")
        return b""


def values_of(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The elements of the array that a binary stream holds, or its one value, in bounded memory."""
    cut = Splitter()
    while data := stream.read(chunk):
        yield from (x for x in cut.feed(data) if x)
    if rest := cut.finish():
        yield rest


def files_of(spark: SparkSession, path) -> DataFrame:
    """(path, length): the files at path, without what is in them."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


class Part:
    """A stretch of a file's bytes, and what an array's splitter would know at its start."""

    FIELDS = "path string, begin long, end long, inside boolean, depth long, state string, first long"

    @staticmethod
    def slashes(f, at: int) -> int:
        """How many backslashes stand just before a place."""
        n, step = 0, 64
        while at > n:
            low = max(0, at - n - step)
            f.seek(low)
            data = f.read(at - n - low)
            run = len(data) - len(data.rstrip(b"\\"))
            n += run
            if run < len(data):
                break
            step *= 4
        return n

    @staticmethod
    def summary(f, begin: int, end: int) -> dict:
        """What a stretch does to the splitter's state, if it begins outside of strings [0] or inside of one [1]: the
        change of depth, the lowest depth after a closing, and how many commas stand at each depth that isn't above the
        start's. root: the first byte that isn't blank."""
        slashes, quotes, root = Part.slashes(f, begin), 0, None
        depth, low, commas = [0, 0], [None, None], [{}, {}]
        f.seek(begin)
        for at in range(begin, end, CHUNK):
            data = f.read(min(CHUNK, end - at))
            if root is None:
                text = (data.removeprefix(BOM.encode()) if at == 0 else data).lstrip(BLANK)
                root = chr(text[0]) if text else None
            places, kind, seen, slashes = marks(np.frombuffer(data, np.uint8), slashes)
            if not len(places):
                continue
            for h in (0, 1):
                free = kind[((seen + quotes + h) % 2 == 0) & (kind != 1)]
                level = depth[h] + np.cumsum(_STEP[free])
                if (free == 3).any():
                    least = int(level[free == 3].min())
                    low[h] = least if low[h] is None else min(low[h], least)
                for k, n in zip(*(v.tolist() for v in np.unique(level[(free == 4) & (level <= 1)], return_counts=True)), strict=True):
                    commas[h][k] = commas[h].get(k, 0) + n
                depth[h] = int(level[-1]) if len(level) else depth[h]
            quotes += int(seen[-1])
        return {"root": root, "quotes": quotes, "depth": depth, "low": low, "commas": [list(c.items()) for c in commas]}

    @staticmethod
    def chained(path: str, size: int, found: list[tuple[int, int, dict]]) -> list[tuple]:
        """FIELDS of the stretches of one file, by what all stretches before them do. A root that is no array is one
        value, and its file one stretch."""
        root = next((s["root"] for _, _, s in found if s["root"]), None)
        if root != "[":
            return [(path, 0, size, False, 0, "before", 0)]
        out, inside, depth, n, state = [], 0, 0, 0, "before"
        for begin, end, s in found:
            if state == "before" and s["root"] is None:
                continue
            out.append((path, begin, end, bool(inside), depth, state, n))
            if state == "done":
                continue
            n += dict(map(tuple, s["commas"][inside])).get(1 - depth, 0) + (state == "before")
            low, state = s["low"][inside], "array"
            if low is not None and depth + low <= 0:
                state = "done"
            depth += s["depth"][inside]
            inside = (inside + s["quotes"]) % 2
        return out

    @staticmethod
    def values(f, size: int, begin: int, end: int, inside: bool, depth: int, state: str, chunk: int) -> Iterator[bytes]:
        """The elements that begin within a stretch. The last of them may end after it."""
        cut = Splitter()
        if state != "before":
            cut.state, cut.first, cut.inside, cut.depth = state, False, inside, depth
            cut.slashes, cut.skip = Part.slashes(f, begin), state == "array"
        f.seek(begin)
        at = begin
        while at < end and (data := f.read(min(chunk, end - at))):
            at += len(data)
            yield from (x for x in cut.feed(data) if x)
        while cut.state == "array" and not cut.skip and (data := f.read(chunk)):
            at += len(data)
            for x in cut.feed(data):
                if x:
                    yield x
                return
        if at >= size and (rest := cut.finish()):
            yield rest


def parts_of(spark: SparkSession, files: list[tuple[str, int]], size: int) -> list[tuple]:
    """Part.FIELDS of files of (path, bytes), cut into stretches of a size that tasks look at side by side."""
    bytes_of = dict(files)
    cuts = [(path, at, min(at + size, n)) for path, n in files for at in range(0, n, size)]

    def look(cut):
        path, begin, end = cut
        fs, at = place(path)
        with fs.open_input_file(at) as f:
            return path, begin, end, Part.summary(f, begin, end)

    found: dict[str, list] = {}
    for path, begin, end, s in spark.sparkContext.parallelize(cuts, len(cuts)).map(look).collect():
        found.setdefault(path, []).append((begin, end, s))
    return [p for path, some in found.items() for p in Part.chained(path, bytes_of[path], sorted(some, key=lambda x: x[:2]))]


def read_json_array(spark: SparkSession, path, chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """(src, record_idx, rec): the objects of the arrays, or the single objects, that the files at path hold.

    Files may have any size, and memory is bounded. Files above part bytes are cut into stretches: one job finds what
    each does to the depth and to the parity of quotes, so that each one's start is known, and then tasks cut their own
    stretches into elements. Smaller files, and compressed ones, are split as a stream by one task each. Elements are
    parsed apart from each other. Files without any byte hold no records.
    """
    prepare(spark)
    ship(spark)
    files = files_of(spark, path)
    large = (F.col("length") > part) & ~F.col("path").rlike(r"\.(gz|bz2|lz4|zst|br|snappy)$")
    found = [tuple(r) for r in files.where(large).collect()]
    cut = parts_of(spark, found, part) if found else []
    small = files.where(~large)
    n = small.count()
    todo = small.repartition(max(1, n), "path").select("path", *[F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in Part.FIELDS.split(", ")[1:])])
    if cut:
        stretches = spark.createDataFrame(spark.sparkContext.parallelize(cut, len(cut)), Part.FIELDS)
        todo = todo.unionByName(stretches) if n else stretches

    def batch(name: str, first: int, rows: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(first, first + len(rows)), pa.int64()), pa.array(rows)], names=["src", "record_idx", "value"])

    def of(one: dict) -> Iterator[bytes]:
        fs, at = place(one["path"])
        if one["state"] is None:
            with fs.open_input_stream(at) as stream:
                yield from values_of(stream, chunk)
        else:
            with fs.open_input_file(at) as f:
                yield from Part.values(f, f.size(), *(one[k] for k in ("begin", "end", "inside", "depth", "state")), chunk)

    def run(batches):
        for b in batches:
            for one in b.to_pylist():
                rows, size, n = [], 0, one["first"] or 0
                for x in of(one):
                    rows.append(x.decode())
                    size += len(x)
                    if size >= BATCH:
                        yield batch(one["path"], n, rows)
                        n, rows, size = n + len(rows), [], 0
                if rows:
                    yield batch(one["path"], n, rows)

    rows = todo.mapInArrow(run, "src string, record_idx long, value string")
    return with_record(rows, "element").select("src", "record_idx", "rec")


def container_hint(first: Column, name: Column) -> Column:
    """ndjson or json_array, from the first characters of a text and its file's name: [ is an array; { is undecided and
    the name's ending counts; anything else is NDJSON."""
    c = F.substring(F.regexp_replace(first, rf"^{BOM}?\s*", ""), 1, 1)
    ending = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.when(c == "[", "json_array").when((c == "{") & (ending == "json"), "json_array").otherwise("ndjson")


def peeked(spark: SparkSession, path: str) -> tuple[str, bytes] | None:
    """Name of the first file at path, and its first PEEK bytes; nothing more is read."""
    found = files_of(spark, path).orderBy("path").limit(1).collect()
    if not found:
        return None
    fs, at = place(found[0]["path"])
    with fs.open_input_stream(at) as f:
        return found[0]["path"], f.read(PEEK)


def several_values(path: str) -> bool:
    """Whether text follows the first value of a file. Read as a stream, up to the end of that value."""
    fs, at = place(path)
    with fs.open_input_stream(at) as f:
        try:
            for _ in values_of(f):
                pass
        except errors.JsonError:
            return True
        except errors.UnexpectedEof:
            return False
    return False


def read_auto(spark: SparkSession, path: str, ndjson: bool = False, array: bool = False) -> tuple[DataFrame, str]:
    """Records of a file or folder and the container that was found, unless a flag names it.

    A file whose ending says array but that holds several objects is read as NDJSON, so that no line is lost.
    """
    if ndjson and array:
        raise errors.TypeMismatch("a source can't be NDJSON and an array at once")
    hint = "ndjson" if ndjson else "json_array" if array else None
    if hint is None:
        prepare(spark)
        hint = "ndjson"
        if head := peeked(spark, path):
            name, first = head
            text = first.decode("utf-8", "ignore").removeprefix(BOM).lstrip()
            if text[:1] == "[" or text[:1] == "{" and name.lower().endswith(".json") and not several_values(name):
                hint = "json_array"
    return (read_ndjson if hint == "ndjson" else read_json_array)(spark, path), hint
