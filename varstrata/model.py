"""Records: rows of (src, record_idx, rec), where rec is a VARIANT object.

A field that isn't in rec is absent (SQL NULL when read); one that is there may hold JSON's null. record_idx counts the
records of a source from 0, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varstrata.scratch import stash

COLUMNS = ("src", "record_idx", "rec")


def field_path(name: str) -> str:
    return '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]' if '"' not in name else "$['" + name + "']"


def field(rec: Column, name: str) -> Column:
    """A top-level field as a VARIANT: NULL if absent. Pushed into Parquet scans of rec."""
    return F.variant_get(rec, field_path(name), "variant")


def from_rows(df: DataFrame, src: str, idx: Column | None = None, order: list[str] | None = None, drop_null: bool = False) -> DataFrame:
    """Records from the rows of any DataFrame: every column is a field; null columns are JSON nulls, or absent if
    drop_null. idx: the record's number, if the rows know it; else they are numbered in the order of columns."""
    rec = F.parse_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": str(drop_null).lower()})).alias("rec")
    if idx is not None:
        return df.select(F.lit(src).alias("src"), idx.cast("long").alias("record_idx"), rec)
    rows = df.select(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order or [])], F.lit(src).alias("src"), rec)
    return numbered(rows, [f"_o{k}" for k in range(len(order or []))]).select(*COLUMNS)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with record_idx: places in the order of columns, counted from 0 over all partitions.

    Rows are sorted into ranges and written with their place within the range; what stands before a range is added from
    the ranges' counts. Rows that are equal in these columns are ordered by a hash of their record, so that a value which
    many rows have is dealt to several ranges. No task sees all rows, and the numbers hold if a task runs again.
    """
    by = [*order, F.xxhash64(F.to_json("rec"))]
    part = rows.repartitionByRange(*by).sortWithinPartitions(*by) if order else rows
    held = stash(part.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    held = held.withColumn("_p", F.call_function("shiftright", "_m", F.lit(33)))
    offsets = held.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)))
    place = F.coalesce("_before", F.lit(0)) + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(offsets), "_p").withColumn("record_idx", place).drop("_m", "_p", "_n", "_before")


def fields_of(rec: Column) -> Column:
    return F.map_keys(rec.cast("map<string,variant>"))


def cells(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep..., field, value): one row for each field that a record has. keep defaults to src and record_idx."""
    keep = ["src", "record_idx"] if keep is None else keep
    return records.select(*keep, F.explode(F.col("rec").cast("map<string,variant>")).alias("field", "value"))
