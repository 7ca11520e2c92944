"""Which encoding a column of a block takes, as window and aggregate plans over its cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varstrata.limits import Limits


def deltas(ints: DataFrame, keys: list[str], order: str = "record_idx", value: str = "v") -> DataFrame:
    """ints with delta: the difference to the value before, the value itself for the first. In DECIMAL, so that it can't
    overflow."""
    d = F.col(value).cast("decimal(38,0)")
    return ints.withColumn("delta", d - F.coalesce(F.lag(d).over(W.partitionBy(*keys).orderBy(order)), F.lit(0).cast("decimal(38,0)")))


def delta_decision(ints: DataFrame, keys: list[str], order: str = "record_idx", value: str = "v") -> DataFrame:
    """(keys, n, use_delta): two values at least, each larger than the one before, and steps that differ by less than
    half of the whole distance."""
    d = F.col(value).cast("decimal(38,0)")
    step = ints.withColumn("_d", d - F.lag(d).over(W.partitionBy(*keys).orderBy(order)))
    small, large = F.min("_d"), F.max("_d")
    span = F.max(d) - F.min(d)
    use = (F.count("*") >= 2) & F.coalesce(small > 0, F.lit(False)) & F.coalesce(2 * (large - small) < span, F.lit(False)) & F.coalesce(span <= F.lit(2**63 - 1).cast("decimal(38,0)"), F.lit(False))
    return step.groupBy(*keys).agg(F.count("*").alias("n"), use.alias("use_delta"))


def dictionary_decision(strings: DataFrame, keys: list[str], value: str = "v", most: int | None = None, limits: Limits = Limits()) -> DataFrame:
    """(keys, n, distinct, use_dict): at most an eighth as many entries as strings, or two, and no more than the limit."""
    limit = min(limits.dict_entries if most is None else most, limits.dict_entries)
    n, distinct = F.count("*"), F.countDistinct(value)
    least = F.greatest(F.lit(2), F.floor(n / 8))
    return strings.groupBy(*keys).agg(n.alias("n"), distinct.alias("distinct"), (F.lit(limit > 0) & (distinct <= F.least(F.lit(limit), least))).alias("use_dict"))


def dictionary(strings: DataFrame, keys: list[str], order: str = "record_idx", value: str = "v") -> DataFrame:
    """(keys, value, entry): entries from 0 in the order in which they first occur. Rows are reduced to distinct values
    before they are numbered, so a window holds one column's dictionary."""
    first = strings.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    return first.withColumn("entry", F.row_number().over(W.partitionBy(*keys).orderBy("_first")).cast("long") - 1).drop("_first")
