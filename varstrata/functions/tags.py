"""Type tags and names of VARIANT values, as expressions.

A cell of a record is one of seven kinds. Numbers are int if they are integers of 64 bits, else decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tags by code. Code 7 is reserved.
TAGS = ("null", "bool", "int", "decimal", "string", "object", "array")


def tag(v: Column) -> Column:
    """The tag's name; SQL NULL for an absent value."""
    return tag_of(F.schema_of_variant(v))


def tag_of(s: Column) -> Column:
    """The tag's name by what schema_of_variant says."""
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s == "VOID", "null")
        .when(s == "BOOLEAN", "bool")
        .when(s == "BIGINT", "int")
        .when(s.startswith("DECIMAL") | (s == "DOUBLE") | (s == "FLOAT"), "decimal")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("string")
    )


def is_object(v: Column) -> Column:
    """Whether tag(v) is object, from one look at the value; SQL NULL for an absent one."""
    return F.schema_of_variant(v).startswith("OBJECT")


def tag_code(v: Column) -> Column:
    name = tag(v)
    out = F.lit(None).cast("int")
    for code, t in enumerate(TAGS):
        out = F.when(name == t, code).otherwise(out)
    return out


def json_type(v: Column) -> Column:
    """Names for messages: null, boolean, number, string, array, object."""
    t = tag(v)
    return F.when(t == "bool", "boolean").when(t.isin("int", "decimal"), "number").otherwise(t)


def minified(v: Column) -> Column:
    """JSON without white space, keys in order."""
    return F.to_json(v)


def text(v: Column) -> Column:
    """A scalar as it is written in a cell: strings without quotes, null empty, numbers in JSON's spelling, nested
    values as minified JSON."""
    t = tag(v)
    return F.when(t.isNull() | (t == "null"), F.lit("")).when(t == "string", v.cast("string")).otherwise(F.to_json(v))
