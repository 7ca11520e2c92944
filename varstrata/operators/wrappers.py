"""Reshaping of whole JSON documents into records.

Input is (src, value), a document of text per row; output is (src, record_idx, rec). Everything is an expression on the
parsed document and one explode, so documents are reshaped in parallel and nothing is shuffled. Broken rules are errors
of the row that breaks them, named as in varstrata.errors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrata.errors import WrapperError
from varstrata.functions.scalars import format_size, size_text
from varstrata.functions.tags import json_type, tag
from varstrata.limits import WrapperLimits
from varstrata.model import field_path
from varstrata.sources.text import strict

MAP = "map<string,variant>"
#: Fixed value: bytes of a key.
MOST_KEY_BYTES = 16 << 20


def fail(kind: str, *parts, of: str = "variant") -> Column:
    return F.raise_error(F.concat(F.lit(f"{kind}: "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])).cast(of)


def parse_pointer(pointer: str, limits: WrapperLimits) -> list[str]:
    """The tokens of an RFC 6901 pointer; none for the root."""
    if len(pointer) > limits.pointer_chars:
        raise WrapperError("PointerTooLong", f"{len(pointer)} characters; at most {limits.pointer_chars}")
    if not pointer:
        return []
    if pointer[0] != "/":
        raise WrapperError("InvalidPointer", f"{pointer!r} must be empty or begin with /")
    tokens = pointer[1:].split("/")
    if len(tokens) > limits.depth:
        raise WrapperError("PointerTooDeep", f"{len(tokens)} steps; at most {limits.depth}")
    if bad := next((t for t in tokens if re.search("~(?![01])", t)), None):
        raise WrapperError("InvalidPointer", f"~ must be ~0 or ~1 in {bad!r}")
    return [t.replace("~1", "/").replace("~0", "~") for t in tokens]


def as_jq(pointer: str) -> str:
    """The pointer as a jq path, for messages."""
    tokens = [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]
    return "".join(f".{t}" if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", t) else f"[{t}]" if t.isdigit() else f'["{t}"]' for t in tokens) or "."


def suggested_size(found: int) -> str:
    return format_size(int(found * 1.5))


def step(v: Column, token: str) -> Column:
    """A member by key, or an element by number."""
    by_key = F.variant_get(v, field_path(token), "variant")
    return F.coalesce(by_key, F.variant_get(v, f"$[{int(token)}]", "variant")) if re.fullmatch("0|[1-9][0-9]{0,8}", token) else by_key


def navigate(v: Column, tokens: list[str], pointer: str, missing: Callable[[Column], Column] | None = None) -> Column:
    """What the pointer leads to; where a step leads nowhere, missing(where it was) or an error that lists keys."""

    def nowhere(at: Column) -> Column:
        keys = F.when(tag(at) == "object", F.concat(F.lit("; keys: "), F.array_join(F.slice(F.map_keys(at.cast(MAP)), 1, 10), ", "))).otherwise("")
        return fail("PointerNotFound", pointer, f" (jq: {as_jq(pointer)})", keys)

    for t in tokens:
        on = step(v, t)
        v = F.when(v.isNull(), v).when(on.isNotNull(), on).otherwise((missing or nowhere)(v))
    return v


def parsed(docs: DataFrame, limits: WrapperLimits, trailing: bool = False) -> DataFrame:
    """(src, root). Documents larger than the buffer, and text after a document, are refused; if trailing, white space
    after a document doesn't count towards its size."""
    size = F.octet_length(F.regexp_replace("value", r"\s+$", "") if trailing else F.col("value"))
    remedy = F.concat(F.lit("; a buffer of "), size_text(F.ceil(size * 1.5)), F.lit(" would do"))
    guarded = F.when(size <= limits.buffer_bytes, F.col("value")).otherwise(fail("BufferLimitExceeded", size.cast("string"), f" bytes; the buffer holds {format_size(limits.buffer_bytes)}", remedy, of="string"))
    return docs.select("src", strict(guarded).alias("root"))


def exploded(df: DataFrame, items: Column) -> DataFrame:
    return df.select("src", F.posexplode(items).alias("record_idx", "rec")).withColumn("record_idx", F.col("record_idx").cast("long"))


def objects(items: Column, kind: str, what: str) -> Column:
    return F.transform(items, lambda x: F.when(tag(x) == "object", x).otherwise(fail(kind, what, " is ", F.coalesce(json_type(x), F.lit("absent")))))


def with_field(rec: Column, name: str, value: Column, clash: str | None) -> Column:
    """rec with a string field; clash names the error if it is there already, None overwrites it."""
    m = rec.cast(MAP)
    rest = F.map_filter(m, lambda k, _: k != name)
    whole = F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(name), value.cast("variant"))))
    return whole if clash is None else F.when(F.map_contains_key(m, name), fail(clash, f"the field {name} is there already")).otherwise(whole)


def pointer(docs: DataFrame, at: str, limits: WrapperLimits = WrapperLimits()) -> DataFrame:
    """An array yields a record for each element, an object one record."""
    root = parsed(docs, limits, trailing=True).withColumn("t", navigate(F.col("root"), parse_pointer(at, limits), at))
    kind = tag(F.col("t"))
    items = F.when(kind == "array", F.col("t").cast("array<variant>")).when(kind == "object", F.array("t")).otherwise(fail("PointerTargetWrongType", f"{at} is ", json_type(F.col("t")), of="array<variant>"))
    return exploded(root, objects(items, "ElementNotObject", f"an element of {at}"))


@dataclass(frozen=True)
class Section:
    name: str
    pointer: str | None = None
    label: str | None = None

    @classmethod
    def of(cls, spec: str) -> Section:
        """name, or name=/pointer."""
        name, given, at = spec.partition("=")
        return cls(name, at if given else None)


def _labelled(items: Column, name: str, label: str) -> Column:
    return F.transform(items, lambda x: with_field(x, name, F.lit(label), "SectionLabelCollision"))


def sections(docs: DataFrame, specs: list[Section | str], label_field: str | None = "_section", required: bool = False, limits: WrapperLimits = WrapperLimits()) -> DataFrame:
    """The arrays of several sections, one after the other, each record labelled with its section.

    label_field None leaves records as they are. A section that is missing is empty, or an error if required.
    """
    specs = [Section.of(s) if isinstance(s, str) else s for s in specs]
    root = parsed(docs, limits).withColumn("root", F.when(tag(F.col("root")) == "object", F.col("root")).otherwise(fail("RootNotObject", "the document is ", json_type(F.col("root")))))
    parts = []
    for s in specs:
        at = "/" + s.name if s.pointer is None else s.pointer
        missing = (lambda v, s=s: fail("SectionNotFound", s.name)) if required else (lambda v: F.lit(None).cast("variant"))
        t = navigate(F.col("root"), parse_pointer(at, limits), at, missing)
        items = F.when(t.isNull(), F.array().cast("array<variant>")).when(tag(t) == "array", t.cast("array<variant>")).otherwise(fail("SectionNotArray", f"{s.name} is ", json_type(t), of="array<variant>"))
        items = objects(items, "SectionElementNotObject", f"an element of {s.name}")
        parts.append(items if label_field is None else _labelled(items, label_field, s.label or s.name))
    return exploded(root, F.concat(*parts))


def keyed_map(docs: DataFrame, at: str = "", key_field: str = "_key", overwrite: bool = False, limits: WrapperLimits = WrapperLimits()) -> DataFrame:
    """A record for each entry of an object of objects, with its key as a field; entries by key."""
    root = parsed(docs, limits).withColumn("t", navigate(F.col("root"), parse_pointer(at, limits), at))
    entries = F.when(tag(F.col("t")) == "object", F.map_entries(F.col("t").cast(MAP))).otherwise(fail("MapNotObject", "the map is ", json_type(F.col("t")), of="array<struct<key:string,value:variant>>"))

    def one(e: Column) -> Column:
        record = F.when(tag(e["value"]) == "object", e["value"]).otherwise(fail("MapValueNotObject", e["key"], " is ", json_type(e["value"])))
        return F.when(F.octet_length(e["key"]) > MOST_KEY_BYTES, fail("MapKeyTooLong", F.octet_length(e["key"]).cast("string"), " bytes")).otherwise(with_field(record, key_field, e["key"], None if overwrite else "MapKeyCollision"))

    return exploded(root, F.transform(entries, one))


def array_headers(docs: DataFrame, limits: WrapperLimits = WrapperLimits()) -> DataFrame:
    """An array whose first element names the fields of the arrays after it. Of a name given twice the last counts."""
    root = parsed(docs, limits)
    rows = F.when(tag(F.col("root")) == "array", F.col("root").cast("array<variant>")).otherwise(fail("RootNotArray", "the document is ", json_type(F.col("root")), of="array<variant>"))
    root = root.select("src", rows.alias("rows")).withColumn("first", F.get("rows", F.lit(0)))
    named = F.when(tag(F.col("first")) == "array", F.col("first").cast("array<variant>"))
    sound = named.isNotNull() & (F.size(named) > 0) & F.forall(named, lambda x: tag(x) == "string")
    header = F.when(F.coalesce(sound, F.lit(False)), F.transform(named, lambda x: x.cast("string"))).otherwise(fail("InvalidHeaderRow", "Header elements must be strings, at least one", of="array<string>"))
    root = root.withColumn("header", header).withColumn("last", F.filter(F.sequence(F.lit(0), F.size("header") - 1), lambda i: ~F.array_contains(F.slice("header", i + 2, F.size("header")), F.col("header")[i])))

    def one(row: Column, i: Column) -> Column:
        cells = F.when(tag(row) == "array", row.cast("array<variant>")).otherwise(fail("ArrayRowNotArray", "row ", (i + 1).cast("string"), of="array<variant>"))
        zipped = F.to_variant_object(F.map_from_arrays(F.transform("last", lambda k: F.col("header")[k]), F.transform("last", lambda k: cells[k])))
        return F.when(F.size(cells) == F.size("header"), zipped).otherwise(fail("ArrayRowLengthMismatch", "Row length mismatch in row ", (i + 1).cast("string"), ": ", F.size(cells).cast("string"), " of ", F.size("header").cast("string")))

    return exploded(root, F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), one))


@dataclass(frozen=True)
class Plugin:
    """process(docs, config, limits) gives records; validate(config) raises if the config makes no sense."""

    name: str
    process: Callable[[DataFrame, dict, WrapperLimits], DataFrame]
    version: str = ""
    description: str = ""
    validate: Callable[[dict], None] | None = None
    schema_hints: tuple[tuple[str, str], ...] = ()


_plugins: dict[str, Plugin] = {}


def register(plugin: Plugin) -> None:
    if plugin.name in _plugins:
        raise WrapperError("PluginExists", plugin.name)
    _plugins[plugin.name] = plugin


def unregister(name: str) -> bool:
    return _plugins.pop(name, None) is not None


def plugins() -> list[Plugin]:
    return sorted(_plugins.values(), key=lambda p: p.name)


def plugin(docs: DataFrame, name: str, config: dict | None = None, limits: WrapperLimits = WrapperLimits()) -> DataFrame:
    if name not in _plugins:
        raise WrapperError("PluginNotFound", f"{name}; there are {', '.join(sorted(_plugins)) or 'none'}")
    p = _plugins[name]
    if p.validate:
        try:
            p.validate(config or {})
        except ValueError as e:
            raise WrapperError("PluginConfigInvalid", f"{name}: {e}") from e
    return p.process(docs, config or {}, limits)


def apply(docs: DataFrame, pointer_at: str | None = None, section_specs: list | None = None, map_at: str | None = None, headers: bool = False, plugin_name: str | None = None, limits: WrapperLimits = WrapperLimits(), **options) -> DataFrame:
    """One of the reshapings; naming two is an error."""
    modes = [pointer_at is not None, bool(section_specs), map_at is not None, headers, plugin_name is not None]
    if sum(modes) != 1:
        raise ValueError("name exactly one of pointer_at, section_specs, map_at, headers, plugin_name")
    if pointer_at is not None:
        return pointer(docs, pointer_at, limits)
    if section_specs:
        return sections(docs, section_specs, limits=limits, **options)
    if map_at is not None:
        return keyed_map(docs, map_at, limits=limits, **options)
    return array_headers(docs, limits) if headers else plugin(docs, plugin_name, options.get("config"), limits)


def metrics(records: DataFrame, label_field: str = "_section") -> DataFrame:
    """(section, records): how many records each section gave; section is null where there is no label."""
    return records.groupBy(F.variant_get("rec", field_path(label_field), "string").alias("section")).agg(F.count("*").alias("records"))


def run_metrics(docs: DataFrame, limits: WrapperLimits = WrapperLimits(), **mode) -> DataFrame:
    """One row of what apply(docs, limits=limits, **mode) does: mode, pointer, documents, peak_buffer (bytes of the largest
    document), records, sections (records by label) and header_fields (names in the longest header row)."""
    records = apply(docs, limits=limits, **mode)
    names = {"pointer_at": "pointer", "section_specs": "sections", "map_at": "map", "headers": "array_headers", "plugin_name": "plugin"}
    used = next(k for k in names if mode.get(k) not in (None, False, []))
    whole = docs.agg(F.count("*").alias("documents"), F.max(F.octet_length("value")).cast("long").alias("peak_buffer"))
    label = mode.get("label_field", "_section")
    by = metrics(records, label) if used == "section_specs" and label else records.groupBy(F.lit(None).cast("string").alias("section")).agg(F.count("*").alias("records"))
    found = by.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.map_from_entries(F.collect_list(F.when(F.col("section").isNotNull(), F.struct("section", "records")))).alias("sections"))
    width = F.size(F.coalesce(F.variant_get(F.parse_json("value"), "$[0]", "array<variant>"), F.array().cast("array<variant>"))) if used == "headers" else F.lit(None)
    header = docs.agg(F.max(width).cast("int").alias("header_fields"))
    at = mode.get("pointer_at") if used == "pointer_at" else mode.get("map_at") if used == "map_at" else None
    return whole.join(found).join(header).select(F.lit(names[used]).alias("mode"), F.lit(at).cast("string").alias("pointer"), "documents", "peak_buffer", "records", "sections", "header_fields")
