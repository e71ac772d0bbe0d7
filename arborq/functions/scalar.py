"""Scalar functions of the query language. Names are looked up without regard to case.

Text functions take the text of any value, so they never give null. Date parts give null for what is not an
instant. register() adds a function of one's own.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborq.functions import values as V
from arborq.functions.expr import Expr, Row, lit
from arborq.functions.values import Value

_REGISTRY: dict[str, tuple[int, int | None, Callable[..., Value], frozenset[str]]] = {}
ANY = None


def register(name: str, least: int, most: int | None = -1, uses: tuple[str, ...] = ()):
    """Register a function of (row, *values) under a name, with its least and most number of arguments."""

    def keep(f: Callable[..., Value]) -> Callable[..., Value]:
        _REGISTRY[name.lower()] = (least, least if most == -1 else most, f, frozenset(uses))
        return f

    return keep


def names() -> list[str]:
    return sorted(_REGISTRY)


def call(name: str, *args: Any) -> Expr:
    """The expression of a registered function; unknown names and wrong counts are errors at once."""
    if name.lower() not in _REGISTRY:
        raise ValueError(f"unknown function {name}")
    if name.lower() == "matches" and len(args) in (2, 3) and all(isinstance(a, str) for a in args[1:]):
        return match(*args)
    least, most, f, uses = _REGISTRY[name.lower()]
    if len(args) < least or (most is not None and len(args) > most):
        raise ValueError(f"{name} takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments, not {len(args)}")
    parts = [lit(a) for a in args]
    return Expr(
        lambda r: f(r, *(p.value(r) for p in parts)),
        uses.union(*(p.uses for p in parts)),
        tuple(a for p in parts for a in p.aggregates),
    )


def _bool(c: Column) -> Value:
    return Value("bool", c)


@register("contains", 2)
def _contains(_: Row, s: Value, n: Value) -> Value:
    return _bool(F.contains(V.text(s), V.text(n)))


@register("startsWith", 2)
def _starts(_: Row, s: Value, p: Value) -> Value:
    return _bool(F.startswith(V.text(s), V.text(p)))


@register("endsWith", 2)
def _ends(_: Row, s: Value, p: Value) -> Value:
    return _bool(F.endswith(V.text(s), V.text(p)))


@register("length", 1)
def _length(_: Row, x: Value) -> Value:
    return Value("num", F.coalesce(F.size(x.col), F.lit(0)) if x.kind == "arr" else F.char_length(V.text(x)))


@register("lower", 1)
def _lower(_: Row, s: Value) -> Value:
    return Value("str", F.lower(V.text(s)))


@register("upper", 1)
def _upper(_: Row, s: Value) -> Value:
    return Value("str", F.upper(V.text(s)))


@register("trim", 1)
def _trim(_: Row, s: Value) -> Value:
    return Value("str", F.regexp_replace(V.text(s), r"(?U)^\s+|\s+$", ""))


@register("split", 2)
def _split(_: Row, s: Value, d: Value) -> Value:
    """Literal delimiter; the empty one parts all characters."""
    quoted = F.concat(F.lit("\\Q"), F.replace(V.text(d), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return Value("arr", F.when(V.text(d) == "", F.split(V.text(s), "")).otherwise(F.split(V.text(s), quoted, -1)))


def _flagged(pattern: str, flags: str) -> str:
    kept = "".join(c for c in "ims" if c in flags)
    return f"(?{kept}){pattern}" if kept else pattern


@F.pandas_udf(T.BooleanType())
def _found(text: pd.Series, pattern: pd.Series, flags: pd.Series) -> pd.Series:
    compiled: dict[str, re.Pattern | None] = {}
    out = []
    for t, p, f in zip(text, pattern, flags, strict=True):
        p = _flagged(p, f)
        if p not in compiled:
            try:
                compiled[p] = re.compile(p)
            except re.error:
                compiled[p] = None
        out.append(compiled[p] is not None and compiled[p].search(t) is not None)
    return pd.Series(out)


@register("matches", 2, 3)
def _matches(_: Row, s: Value, pattern: Value, flags: Value | None = None) -> Value:
    """Unanchored regular expression that differs by row; flags i, m and s. An invalid one gives false."""
    return _bool(_found(V.text(s), V.text(pattern), V.text(flags) if flags else F.lit("")))


def _valid(pattern: str) -> bool:
    """Is it a pattern of the engine that will run it?"""
    session = SparkSession.getActiveSession()
    try:
        if session is not None:
            session.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except Exception:  # noqa: BLE001  whatever the engine raises for a bad pattern
        return False
    return True


def match(s: Any, pattern: str, flags: str = "") -> Expr:
    """matches() with a constant pattern, inside generated code: an invalid one gives false."""
    whole = _flagged(pattern, flags)
    if not _valid(whole):
        return lit(False)
    text = s if isinstance(s, Expr) else lit(s)
    return Expr(lambda r: _bool(F.regexp_like(V.text(text.value(r)), F.lit(whole))), text.uses, text.aggregates)


@register("len", 1)
def _len(_: Row, x: Value) -> Value:
    if x.kind == "arr":
        return Value("num", F.coalesce(F.size(x.col), F.lit(0)))
    return Value("num", F.coalesce(F.char_length(x.col), F.lit(0)) if x.kind == "str" else F.lit(0))


@register("first", 1)
def _first(_: Row, x: Value) -> Value:
    return Value("str", F.try_element_at(x.col, F.lit(1))) if x.kind == "arr" else V.null()


@register("last", 1)
def _last(_: Row, x: Value) -> Value:
    return Value("str", F.try_element_at(x.col, F.lit(-1))) if x.kind == "arr" else V.null()


@register("isEmpty", 1)
def _empty(_: Row, x: Value) -> Value:
    """True for null, the empty text and array, and any number, boolean or instant."""
    return _bool(~V.truth(x) if x.kind in ("str", "arr") else F.lit(True))


@register("exists", 1)
def _exists(_: Row, x: Value) -> Value:
    return _bool(x.col.isNotNull())


@register("coalesce", 1, ANY)
def _coalesce(_: Row, *xs: Value) -> Value:
    some = [x for x in xs if x.kind != "null"]
    if not some:
        return V.null()
    if len({x.kind for x in some}) == 1:
        return Value(some[0].kind, F.coalesce(*(x.col for x in some)))
    return Value("str", F.coalesce(*(F.when(x.col.isNotNull(), V.text(x)) for x in some)))


@register("ifnull", 2)
def _ifnull(r: Row, x: Value, d: Value) -> Value:
    return _coalesce(r, x, d)


@register("now", 0)
def _now(_: Row) -> Value:
    return Value("ts", F.current_timestamp())


@register("date", 1)
def _date(_: Row, s: Value) -> Value:
    return Value("ts", F.try_to_timestamp(V.text(s)))


def _part(name: str, get: Callable[[Column], Column]) -> None:
    register(name, 1)(lambda _, d: Value("num", get(d.col)) if d.kind == "ts" else Value("num", F.lit(None).cast("int")))


for _name, _get in (
    ("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("weekday", lambda c: F.dayofweek(c) - 1), ("hours", F.hour), ("minutes", F.minute),
):
    _part(_name, _get)

#: Names of units and their milliseconds.
DIFF_MS = {
    **dict.fromkeys(("min", "minute", "minutes"), 60_000), **dict.fromkeys(("h", "hour", "hours"), 3_600_000),
    **dict.fromkeys(("d", "day", "days"), 86_400_000), **dict.fromkeys(("w", "week", "weeks"), 7 * 86_400_000),
    **dict.fromkeys(("m", "month", "months"), 30 * 86_400_000), **dict.fromkeys(("y", "year", "years"), 365 * 86_400_000),
}


@register("dateDiff", 3)
def _date_diff(_: Row, a: Value, b: Value, unit: Value) -> Value:
    """Whole units from b to a, rounded down; unknown units are days."""
    if a.kind != "ts" or b.kind != "ts":
        return Value("num", F.lit(None).cast("long"))
    u = F.lower(V.text(unit))
    ms = F.lit(DIFF_MS["d"])
    for name, size in DIFF_MS.items():
        if size != DIFF_MS["d"]:
            ms = F.when(u == name, F.lit(size)).otherwise(ms)
    return Value("num", F.floor((F.unix_millis(a.col) - F.unix_millis(b.col)) / ms))


#: Tokens of format() and what they stand for, in the order in which they are replaced.
FORMAT_TOKENS = [("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("HH", "HH"), ("mm", "mm"), ("ss", "ss")]


@register("format", 2)
def _format(_: Row, d: Value, pattern: Value) -> Value:
    """The first of each token is replaced."""
    if d.kind != "ts":
        return V.null()
    out = V.text(pattern)
    for token, java in FORMAT_TOKENS:
        out = F.regexp_replace(out, f"(?s)^(.*?){token}", F.concat(F.lit("$1"), F.date_format(d.col, java)))
    return Value("str", F.when(d.col.isNotNull(), out))


def _list(r: Row, name: str) -> Column:
    return F.coalesce(r.column(name).col.cast("array<string>"), F.array().cast("array<string>"))


@register("hasTag", 1, uses=("file",))
def _has_tag(r: Row, t: Value) -> Value:
    bare = lambda c: F.lower(F.regexp_replace(c, "^#", ""))
    return _bool(F.coalesce(F.exists(_list(r, "tags"), lambda x: bare(x) == bare(V.text(t))), F.lit(False)))


@register("inFolder", 1, uses=("file",))
def _in_folder(r: Row, f: Value) -> Value:
    folder = F.coalesce(r.column("folder").col, F.lit(None).cast("string"))
    return _bool(F.coalesce((folder == V.text(f)) | F.startswith(folder, F.concat(V.text(f), F.lit("/"))), F.lit(False)))


@register("hasExtension", 1)
def _has_extension(r: Row, e: Value) -> Value:
    ending = F.concat(F.lit("."), F.regexp_replace(F.lower(V.text(e)), "^\\.", ""))
    return _bool(F.coalesce(F.endswith(F.lower(r.column("path").col), ending), F.lit(False)))


@register("hasLink", 1, uses=("file",))
def _has_link(r: Row, t: Value) -> Value:
    return _bool(F.coalesce(F.exists(_list(r, "links"), lambda x: F.contains(F.lower(x), F.lower(V.text(t)))), F.lit(False)))


@register("tags", 0, uses=("file",))
def _tags(r: Row) -> Value:
    return Value("arr", _list(r, "tags"))


@register("outlinks", 0, uses=("file",))
def _outlinks(r: Row) -> Value:
    return Value("arr", _list(r, "links"))


@register("backlinks", 0, uses=("file",))
def _backlinks(r: Row) -> Value:
    return Value("arr", _list(r, "backlinks"))


def today(now: dt.datetime | None = None) -> dt.datetime:
    """One instant to freeze a query's relative days on."""
    return now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
