"""What the training-data operators share: reading, ASCII lower-casing, intermediate tables, the let idiom."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varstrata.scratch import drop, release, shared_dir, stash

__all__ = ["drop", "release", "shared_dir", "stash"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separates words: space and the control characters from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Rows up to which a table of thresholds or weights is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Elements of an array that are gone through one by one; see scan().
RUN = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A to Z alone; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than BLANKS, in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even if body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(values: Column, size: int = RUN) -> Column:
    """An array cut into arrays of size elements; the last may be shorter. An empty one has none."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, F.lit(size)))
    return F.when(F.size(values) > 0, cut).otherwise(F.slice(F.array(values), 1, 0))


def scan(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of longs, op over all elements before it; zero for the first. op is associative.

    Arrays that grow by one element are copied each time, so only runs of RUN elements are grown, and then the list of
    runs: n elements cost about n * RUN steps instead of n * n.
    """
    kind = "array<bigint>"
    start = F.struct(F.lit(zero).cast("long").alias("all"), F.array().cast(kind).alias("before"))

    def grown(over: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(over, start, lambda a, x: F.struct(op(a["all"], value(x)).alias("all"), F.concat(a["before"], F.array(a["all"])).cast(kind).alias("before")))

    def joined(parts: Column) -> Column:
        heads = grown(parts, lambda x: x["all"])["before"]
        return let(heads, lambda h: F.flatten(F.transform(parts, lambda x, k: F.transform(x["before"], lambda v: op(h[k], v)))))

    return let(F.transform(runs(values.cast(kind)), lambda r: grown(r, lambda x: x)), joined)


def small_join(left: DataFrame, right: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a stashed table, broadcast only if it was counted to have few rows."""
    return left.join(F.broadcast(right) if right.count() <= rows else right, on, how)
