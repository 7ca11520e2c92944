"""Scalar functions: as Columns where rows are concerned, as plain Python where a plan is being made."""

from __future__ import annotations

import math
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ...; the result is an unsigned number in a signed one's bits."""
    return F.call_function("shiftleft", v, F.lit(1)).bitwiseXOR(F.call_function("shiftright", v, F.lit(63)))


def unzigzag(u: Column) -> Column:
    return F.call_function("shiftrightunsigned", u, F.lit(1)).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def uleb_length(u: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(u)) / 7)).cast("int")


def string_length(s: Column) -> Column:
    """Bytes of a string with its length before it."""
    n = F.octet_length(s)
    return uleb_length(n.cast("long")) + n


def escape_token(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape_token(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def csv_cell(s: Column) -> Column:
    """Quoted only if it holds a comma, a quote or a line feed; quotes are doubled. Absent is empty."""
    c = F.coalesce(s, F.lit(""))
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def plain_decimal(s: Column) -> Column:
    """A decimal's text without zeros at its end: 1.2300 is 1.23, 5.0 is 5, -0.0 is 0."""
    cut = F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), "[.]$", "")).otherwise(s)
    return F.when(cut.rlike("^-?0*$"), F.lit("0")).otherwise(cut)


def recommended_block_size(records: int, limit: int, largest: int) -> int:
    """Records per block so that the largest segment fills nine tenths of its limit; a thousand at least."""
    if not records or not largest:
        return 1_000
    return max(1_000, -(-records * limit * 9 // (largest * 10)))


def normal_factor(factor: float) -> float:
    """Share of memory to use: 0.75 if it makes no sense, 1 at most."""
    if factor != factor or factor in (float("inf"), float("-inf")) or factor <= 0:
        return 0.75
    return min(factor, 1.0)


#: Below so many bytes, one thread; at most so many threads.
SMALL_INPUT, MOST_THREADS = 10 << 20, 16


def advised_tasks(cores: int, available: int, input_bytes: int, block_bytes: int = 256 << 20, factor: float = 0.75, cap: int | None = None) -> int:
    """How many blocks may be in work at once: each takes twice its limit of the memory that may be used."""
    tasks = min(cores, max(1, int(available * normal_factor(factor) // (2 * block_bytes))), MOST_THREADS, cap or MOST_THREADS)
    return 1 if tasks < 2 or input_bytes < SMALL_INPUT else tasks


_UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30}


def parse_size(s: str) -> int:
    """16M, 1.5K, 300: binary units."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([KMG]?)(?:i?B)?\s*", s, re.IGNORECASE)
    if not m:
        raise ValueError(f"not a size: {s!r}")
    return int(float(m[1]) * _UNITS[m[2].upper()])


def format_size(n: int) -> str:
    for unit in ("G", "M", "K"):
        if n >= _UNITS[unit]:
            return f"{n / _UNITS[unit]:.1f}{unit}"
    return f"{n}B"


def size_text(n: Column) -> Column:
    """format_size() of a column."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for unit in ("K", "M", "G"):
        out = F.when(n >= _UNITS[unit], F.format_string(f"%.1f{unit}", F.bround(n / _UNITS[unit], 1))).otherwise(out)
    return out


#: Fixed value: digits after the point up to which a double's decimal counts as exact.
EXACT_DIGITS = 17


def double_if_exact(text: str) -> float | None:
    """The double that is exactly a decimal, if there is one."""
    d = Decimal(text)
    f = float(d)
    if not math.isfinite(f) or Decimal(f) != d:
        return None
    return f if -d.normalize().as_tuple().exponent <= EXACT_DIGITS else None


def decimal_if_exact(value: float) -> str | None:
    """The shortest decimal of a double, if it is exactly the double. There is none of -0.0."""
    if not math.isfinite(value) or (value == 0 and math.copysign(1, value) < 0):
        return None
    text = format(Decimal(repr(value)), "f")
    return text if double_if_exact(text) == value else None


@F.pandas_udf(DoubleType())
def exact_double(texts: pd.Series) -> pd.Series:
    """double_if_exact() of a column of decimals' texts."""
    return texts.map(lambda t: None if t is None else double_if_exact(t)).astype("Float64")
