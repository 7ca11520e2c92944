"""What an archive holds: blocks, fields, statistics, ranges of blocks."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varstrata.errors import InternalError
from varstrata.functions.tags import TAGS, tag
from varstrata.model import cells

SAMPLE = 50_000


def blocks(records: DataFrame) -> DataFrame:
    """(block, record_count, field_count): blocks count from 1."""
    n = records.groupBy("block_idx").agg(F.count("*").alias("record_count"))
    f = cells(records, ["block_idx"]).groupBy("block_idx").agg(F.countDistinct("field").alias("field_count"))
    return n.join(f, "block_idx", "left").select((F.col("block_idx") + 1).alias("block"), "record_count", F.coalesce("field_count", F.lit(0)).alias("field_count"))


def field_directory(records: DataFrame) -> DataFrame:
    """(block, field, present_count)."""
    return cells(records, ["block_idx"]).groupBy((F.col("block_idx") + 1).alias("block"), "field").agg(F.count("*").alias("present_count"))


def ratio(compressed, uncompressed):
    """Null if there is nothing to compress."""
    return F.when(uncompressed > 0, compressed / uncompressed)


def fields(records: DataFrame) -> DataFrame:
    """(field): all names, in order."""
    return cells(records, []).select("field").distinct().orderBy("field")


def field_stats(records: DataFrame, sample: int | None = None) -> DataFrame:
    """(field, total_records, present, absent, null_count, n_<tag>, sample_size, sampled).

    With a sample, types and nulls are counted over the first so many present values of each field; present and absent
    always over all. Places within a field come from counts per range of records, so that a field that every record has
    isn't ranked in one task.
    """
    if sample is not None and sample < 1:
        raise InternalError("the sample must hold a value at least")
    total = records.agg(F.count("*").alias("total_records"))
    rows = cells(records).select("src", "record_idx", "field", tag(F.col("value")).alias("t"))
    if sample is None:
        counted = rows.withColumn("_in", F.lit(True))
    else:
        # Only the chunk in which the sample ends has to be ranked.
        rows = rows.withColumn("_chunk", F.floor(F.col("record_idx") / 4096))
        per = rows.groupBy("src", "field", "_chunk").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(W.partitionBy("field").orderBy("src", "_chunk").rowsBetween(W.unboundedPreceding, -1))
        per = per.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
        placed = rows.join(per, ["src", "field", "_chunk"])
        rank = F.row_number().over(W.partitionBy("src", "field", "_chunk").orderBy("record_idx"))
        counted = placed.withColumn("_in", F.col("_before") + rank <= sample)
    inside = F.col("_in")
    kinds = [F.count(F.when(inside & (F.col("t") == k), 1)).alias("null_count" if k == "null" else f"n_{k}") for k in TAGS]
    out = counted.groupBy("field").agg(F.count("*").alias("present"), F.count(F.when(inside, 1)).alias("sample_size"), *kinds)
    out = out.crossJoin(F.broadcast(total))
    names = [f"n_{k}" for k in TAGS if k != "null"]
    return out.select("field", "total_records", "present", (F.col("total_records") - F.col("present")).alias("absent"), "null_count", *names, "sample_size", (F.col("sample_size") < F.col("present")).alias("sampled"))


def most_populated(stats: DataFrame) -> str | None:
    """The field with the most present values; of several the last by name."""
    row = stats.orderBy(F.desc("present"), F.desc("field")).limit(1).collect()
    return row[0]["field"] if row else None


def parse_range(spec: str, blocks: int) -> tuple[int, int]:
    """N, N-M, N- or -M, counted from 1, both ends included."""
    m = re.fullmatch(r"\s*(\d*)\s*(-?)\s*(\d*)\s*", spec)
    if not m or not (m[1] or m[3]):
        raise InternalError(f"not a range of blocks: {spec!r}")
    low = int(m[1]) if m[1] else 1
    high = (int(m[3]) if m[3] else blocks) if m[2] else low
    if low < 1 or high < 1:
        raise InternalError("blocks count from 1")
    if low > high:
        raise InternalError(f"the range {spec!r} is reversed")
    if high > blocks:
        raise InternalError(f"the range {spec!r} ends after the last block, {blocks}")
    return low, high


def block_range(records: DataFrame, low: int, high: int) -> DataFrame:
    return records.where(F.col("block_idx").between(low - 1, high - 1))


#: Names that an error lists.
LISTED = 50


def require_field(fields: DataFrame, name: str) -> None:
    """An error that lists fields there are, if name isn't one of (field)."""
    if not fields.where(F.col("field") == name).take(1):
        known = [r["field"] for r in fields.orderBy("field").limit(LISTED + 1).collect()]
        raise InternalError(f"there is no field {name!r}; fields: {', '.join(known[:LISTED])}{', ...' if len(known) > LISTED else ''}")


def render(summary: DataFrame, stats: DataFrame | None = None, style: str = "table", fields_only: bool = False, blocks_only: bool = False, verbose: bool = False, sample: int = SAMPLE, directory: DataFrame | None = None) -> str:
    """Blocks, fields and statistics as tab-separated text or as JSON. These tables have a row for each block or field."""
    shown = [r.asDict() for r in summary.orderBy("block").collect()]
    told = [r.asDict() for r in stats.orderBy("field").collect()] if stats is not None else None
    parts = [r.asDict() for r in directory.orderBy("block", "field").collect()] if directory is not None else []
    names = sorted({p["field"] for p in parts} | {s["field"] for s in told or []})
    if style == "json":
        out: dict = {}
        if not blocks_only:
            out["fields"] = names
        if not fields_only:
            out["blocks"] = [b | {"fields": [{k: v for k, v in p.items() if k != "block"} for p in parts if p["block"] == b["block"]]} if verbose else b for b in shown]
        out["verbose"] = verbose
        if told is not None:
            out |= {"stats": told, "stats_sample_limit": sample}
        return json.dumps(out, indent=2, ensure_ascii=False)
    lines = []
    if not blocks_only:
        lines += ["field", *names]
    if not fields_only:
        lines += ["block\trecords\tfields", *(f"{b['block']}\t{b['record_count']}\t{b['field_count']}" for b in shown)]
        if verbose:
            lines += ["block\tfield\tpresent", *(f"{p['block']}\t{p['field']}\t{p['present_count']}" for p in parts)]
    if told:
        lines += ["\t".join(told[0]), *("\t".join(str(v) for v in s.values()) for s in told)]
        if any(s["sampled"] for s in told):
            lines.append(f"types and nulls are of the first {sample} present values of a field")
    return "\n".join(lines) + "\n"
