"""Expressions over a result row: properties, file and traversal fields, operators, aggregates.

An Expr is worked out against a DataFrame's columns when a clause applies it; nothing is parsed. Python's
operators build them: prop("acctbal") > 5000, ~x, x & y, x | y. Equality is x.eq(y), and so on.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborq.functions import values as V
from arborq.functions.values import Value

#: Milliseconds of a duration's units (a month is 30 days, a year 365).
UNIT_MS = {"d": 86_400_000, "w": 7 * 86_400_000, "m": 30 * 86_400_000, "y": 365 * 86_400_000}
FILE = {"name": "name", "path": "path", "folder": "folder", "created": "created", "modified": "modified", "size": "size", "tags": "tags"}
TRAVERSAL = {"depth": "depth", "relation": "relation", "label": "label", "isImplied": "implied", "parent": "parent", "path": "traversal_path"}


@dataclass(frozen=True)
class Row:
    """What an expression may use: a note's columns (in the struct `inside`, if given), fields of the walk, joined aggregates."""

    notes: dict[str, T.DataType]
    fields: dict[str, T.DataType] = field(default_factory=dict)
    inside: str | None = None
    aggregates: dict[int, Value] = field(default_factory=dict)

    @staticmethod
    def of(df: DataFrame) -> Row:
        """The row of a table of notes itself."""
        return Row({f.name: f.dataType for f in df.schema.fields})

    def raw(self, name: str) -> Column:
        return F.col(f"{self.inside}.`{name}`" if self.inside else f"`{name}`")

    def column(self, name: str) -> Value:
        if name == "path" and "path" in self.fields:
            return Value("str", F.col("path"))
        return V.of_type(self.raw(name), self.notes[name]) if name in self.notes else V.null()

    def walk(self, name: str) -> Value:
        return V.of_type(F.col(f"`{name}`"), self.fields[name]) if name in self.fields else V.null()


@dataclass(frozen=True, eq=False)
class Expr:
    value: Callable[[Row], Value]
    uses: frozenset[str] = frozenset()
    aggregates: tuple[Any, ...] = ()

    def truth(self, row: Row) -> Column:
        return V.truth(self.value(row))

    def _with(self, other: Any, make: Callable[[Value, Value], Value]) -> Expr:
        o = lit(other)
        return Expr(lambda r: make(self.value(r), o.value(r)), self.uses | o.uses, self.aggregates + o.aggregates)

    def eq(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: Value("bool", V.equals(a, b)))

    def ne(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: Value("bool", ~V.equals(a, b)))

    def eq_if_present(self, other: Any) -> Expr:
        """False where this side is null."""
        return self._with(other, lambda a, b: Value("bool", a.col.isNotNull() & V.equals(a, b)))

    def ne_if_present(self, other: Any) -> Expr:
        """True where this side is null."""
        return self._with(other, lambda a, b: Value("bool", a.col.isNull() | ~V.equals(a, b)))

    def __lt__(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: Value("bool", V.compare(a, b, "<")))

    def __gt__(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: Value("bool", V.compare(a, b, ">")))

    def __le__(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: Value("bool", V.compare(a, b, "<=")))

    def __ge__(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: Value("bool", V.compare(a, b, ">=")))

    def __and__(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: Value("bool", V.truth(a) & V.truth(b)))

    def __or__(self, other: Any) -> Expr:
        return self._with(other, lambda a, b: Value("bool", V.truth(a) | V.truth(b)))

    def __invert__(self) -> Expr:
        return Expr(lambda r: Value("bool", ~V.truth(self.value(r))), self.uses, self.aggregates)

    def __add__(self, other: Any) -> Expr:
        return self._with(other, _plus)

    def __sub__(self, other: Any) -> Expr:
        return self._with(other, _minus)

    def is_in(self, other: Any) -> Expr:
        """An element of an array, or a part of a text; false in anything else."""
        return self._with(other, _within)

    def between(self, low: Any, high: Any) -> Expr:
        """Both ends included; null if any of the three is null."""
        lo, hi = lit(low), lit(high)

        def value(r: Row) -> Value:
            x, a, b = self.value(r), lo.value(r), hi.value(r)
            present = x.col.isNotNull() & a.col.isNotNull() & b.col.isNotNull()
            return Value("bool", F.when(present, V.compare(x, a, ">=") & V.compare(x, b, "<=")))

        return Expr(value, self.uses | lo.uses | hi.uses, self.aggregates + lo.aggregates + hi.aggregates)


def _shifted(instant: Column, ms: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(instant) + ms.cast("long"))


def _plus(a: Value, b: Value) -> Value:
    if a.kind == b.kind == "num":
        return Value("num", a.col + b.col)
    if a.kind == "ts" and b.kind == "num":
        return Value("ts", _shifted(a.col, b.col))
    if a.kind == "str" and b.kind != "null":
        return Value("str", F.when(a.col.isNotNull() & b.col.isNotNull(), F.concat(a.col, V.text(b))))
    return V.null()


def _minus(a: Value, b: Value) -> Value:
    if a.kind == b.kind == "num":
        return Value("num", a.col - b.col)
    if a.kind == "ts" and b.kind == "num":
        return Value("ts", _shifted(a.col, -b.col))
    return V.null()


def _within(a: Value, b: Value) -> Value:
    if b.kind == "arr":
        needle = a.col if a.kind in ("str", "null") else F.lit(None).cast("string")
        hit = F.exists(b.col, lambda x: x.eqNullSafe(needle))
        return Value("bool", F.coalesce(hit if a.kind in ("str", "null") else F.lit(False), F.lit(False)))
    if a.kind == b.kind == "str":
        return Value("bool", F.coalesce(F.contains(b.col, a.col), F.lit(False)))
    return Value("bool", F.lit(False))


def lit(x: Any) -> Expr:
    """A constant; expressions pass through."""
    if isinstance(x, Expr):
        return x
    if x is None:
        return Expr(lambda r: V.null())
    if isinstance(x, bool):
        return Expr(lambda r: Value("bool", F.lit(x)))
    if isinstance(x, (int, float)):
        return Expr(lambda r: Value("num", F.lit(x)))
    if isinstance(x, (dt.datetime, dt.date)):
        return Expr(lambda r: Value("ts", F.lit(x).cast("timestamp")))
    if isinstance(x, (list, tuple)):
        return Expr(lambda r: Value("arr", F.array(*map(F.lit, x)).cast("array<string>") if x else F.array().cast("array<string>")))
    return Expr(lambda r: Value("str", F.lit(str(x))))


def prop(name: str, kind: str | None = None) -> Expr:
    """A property. Nested structs are walked by dots, then the flat name is tried; absent ones are null.

    A VARIANT column `properties` is read if there is no column of that name; kind (double, string, boolean,
    timestamp) is then the type wanted.
    """

    def value(r: Row) -> Value:
        if name in r.notes:
            return r.column(name)
        head, *rest = name.split(".")
        kind_, col = r.notes.get(head), r.raw(head)
        for part in rest:
            names = {f.name: f.dataType for f in kind_.fields} if isinstance(kind_, T.StructType) else {}
            kind_, col = names.get(part), col[part] if part in names else col
        if rest and kind_ is not None:
            return V.of_type(col, kind_)
        if isinstance(r.notes.get("properties"), T.VariantType):
            wanted = kind or "string"
            paths = ["$." + ".".join(name.split(".")), f'$["{name}"]']
            found = F.coalesce(*(F.try_variant_get(r.raw("properties"), p, wanted) for p in dict.fromkeys(paths)))
            return Value({"double": "num", "boolean": "bool", "timestamp": "ts"}.get(wanted, "str"), found)
        return V.null()

    return Expr(value, frozenset(["file"]))


def file(name: str) -> Expr:
    return Expr(lambda r: r.column(FILE[name]) if name in FILE else V.null(), frozenset() if name == "path" else frozenset(["file"]))


def traversal(name: str) -> Expr:
    """A field of the walk: depth, relation, label, isImplied, parent or path; null outside one."""
    return Expr(lambda r: r.walk(TRAVERSAL[name]) if name in TRAVERSAL else V.null(), frozenset(["traversal"]))


def duration(count: float, unit: str) -> Expr:
    """Milliseconds, to be added to or taken from an instant."""
    return lit(int(count * UNIT_MS[unit]))


def relative_day(name: str, now: dt.datetime) -> Expr:
    """today, yesterday, tomorrow, startOfWeek (Sunday) or endOfWeek (Saturday), from one fixed instant."""
    day = dt.datetime(now.year, now.month, now.day)
    sunday = day - dt.timedelta(days=(day.weekday() + 1) % 7)
    days = {
        "today": day, "yesterday": day - dt.timedelta(days=1), "tomorrow": day + dt.timedelta(days=1),
        "startOfWeek": sunday, "endOfWeek": sunday + dt.timedelta(days=6),
    }
    return lit(days[name])
