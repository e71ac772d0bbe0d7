"""Values of the query language as typed columns: truth, equality, order and text.

Kinds are str, num, bool, ts, arr (array of strings) and null. Logic has two values: what is absent is false, and
values of different kinds are never equal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERING = "UNICODE"


@dataclass(frozen=True)
class Value:
    kind: str
    col: Column


def null() -> Value:
    return Value("null", F.lit(None).cast("string"))


def of_type(col: Column, kind: T.DataType) -> Value:
    """A column of a Spark type as a value; types outside the language are taken as their text."""
    if isinstance(kind, T.BooleanType):
        return Value("bool", col)
    if isinstance(kind, T.NumericType):
        return Value("num", col)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Value("ts", col.cast("timestamp"))
    if isinstance(kind, T.ArrayType):
        return Value("arr", col.cast("array<string>"))
    if isinstance(kind, T.NullType):
        return null()
    return Value("str", col if isinstance(kind, T.StringType) else col.cast("string"))


def truth(v: Value) -> Column:
    """False for null, false, 0, the empty text and the empty array; NaN is true."""
    c = v.col
    if v.kind == "bool":
        return F.coalesce(c, F.lit(False))
    if v.kind == "num":
        return F.coalesce(c != 0, F.lit(False))
    if v.kind == "str":
        return F.coalesce(c != "", F.lit(False))
    if v.kind == "arr":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull() if v.kind == "ts" else F.lit(False)


def text_of_number(c: Column) -> Column:
    """Shortest digits: without a fraction part if whole, in plain form from 1e-6 to below 1e21, else with an exponent."""
    d = c.cast("double")
    size = F.abs(d)
    short = d.cast("string")
    whole = F.when(size < 1e15, F.floor(d).cast("string")).otherwise(short.cast("decimal(38,0)").cast("string"))
    plain = F.regexp_replace(short.cast("decimal(38,22)").cast("string"), r"0+$", "")
    exponent = F.replace(F.regexp_replace(F.replace(short, F.lit(".0E"), F.lit("E")), "E(?=[0-9])", "e+"), F.lit("E-"), F.lit("e-"))
    return (
        F.when(d == 0, F.lit("0"))
        .when((d == F.floor(d).cast("double")) & (size < 1e18) | (size >= 1e18) & (size < 1e21), whole)
        .when((size >= 1e-6) & (size < 1e15), plain)
        .when(F.isnan(d) | (size == float("inf")), short)
        .otherwise(exponent)
    )


def text(v: Value) -> Column:
    """Text of a value: null is empty, instants are ISO in UTC, arrays are joined by commas."""
    if v.kind == "str":
        return F.coalesce(v.col, F.lit(""))
    if v.kind == "num":
        return F.coalesce(text_of_number(v.col), F.lit(""))
    if v.kind == "bool":
        return F.coalesce(v.col.cast("string"), F.lit(""))
    if v.kind == "ts":
        return F.coalesce(F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
    if v.kind == "arr":
        return F.coalesce(F.array_join(v.col, ","), F.lit(""))
    return F.lit("")


def equals(a: Value, b: Value) -> Column:
    """Null-safe equality without coercion: different kinds differ unless both are null."""
    if a.kind == "null" or b.kind == "null":
        return a.col.isNull() & b.col.isNull()
    if a.kind != b.kind:
        return a.col.isNull() & b.col.isNull()
    return a.col.eqNullSafe(b.col)


def ordered(c: Column) -> Column:
    """Text under the language's collation, for comparing and sorting."""
    return F.collate(c, ORDERING)


def compare(a: Value, b: Value, op: str) -> Column:
    """a op b for < > <= >=, null if either is null; values of different kinds compare by their texts."""
    if a.kind == b.kind and a.kind in ("num", "ts", "bool"):
        x, y = a.col, b.col
    elif "null" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    else:
        x, y = ordered(text(a)), ordered(text(b))
    found = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    return F.when(a.col.isNotNull() & b.col.isNotNull(), found)


def sort_key(v: Value) -> Column:
    return ordered(v.col) if v.kind == "str" else ordered(text(v)) if v.kind == "arr" else v.col
