import datetime as dt

import pytest

from pyspark.sql import functions as F

from arborq.functions import scalar, values
from arborq.functions.expr import Row, duration, lit, prop, relative_day

f = scalar.call


@pytest.fixture(scope="module")
def notes(spark):
    day = dt.datetime(2024, 2, 29, 13, 5, 9)
    rows = [("x/a.md", "a", "x", day, ["#Red", "blue"], ["x/B.md"], ["x/c.md"], 2.5, 3, "Text", True, None, (1, "deep"), "[1]")]
    schema = (
        "path string, name string, folder string, created timestamp, tags array<string>, links array<string>, backlinks array<string>, num double, whole long, "
        "str string, flag boolean, nothing string, nest struct<one:int,two:string>, `a.b` string"
    )
    return spark.createDataFrame(rows, schema)


def value(notes, expr):
    return notes.select(expr.value(Row.of(notes)).col.alias("v")).first()["v"]


NONE = prop("nothing")
DAY = prop("created")
CASES = [
    (~NONE, True), (NONE.ne(1), True), (NONE.eq_if_present(None), False), (NONE.ne_if_present(None), True), (NONE.eq(None), True), (prop("num").eq("2.5"), False),
    (prop("num") < NONE, None), (prop("num").between(2, 3), True), (prop("num").between(2, None), None), (prop("num") > "10", True), (prop("whole") + 1, 4),
    (prop("str") + 1, "Text1"), (prop("str") + prop("num"), "Text2.5"), (prop("num") + "x", None), (prop("str") + NONE, None), (DAY - DAY, None),
    (DAY + duration(1, "m"), dt.datetime(2024, 3, 30, 13, 5, 9)), (lit("b").is_in(lit(["a", "b"])), True), (lit(None).is_in(lit(["a"])), False), (lit("ex").is_in(prop("str")), True),
    (lit("ex").is_in(NONE), False), (prop("nest.two"), "deep"), (prop("a.b"), "[1]"), (prop("none.at.all"), None), (prop("flag") & prop("num"), True), (prop("flag") & lit(0), False),
    (lit("") | lit([]), False), (f("length", None), 0), (f("LENGTH", "abc"), 3), (f("len", 5), 0), (f("contains", 12, 2), True), (f("trim", "  a\t"), "a"), (f("split", "a.b", "."), ["a", "b"]),
    (f("split", "abc", ""), ["a", "b", "c"]), (f("matches", "aXb", "x", "i"), True), (f("matches", "aXb", "x"), False), (scalar.match("a", "("), False), (f("matches", "a", "("), False), (f("matches", "a", prop("str") + "("), False), (f("matches", "xText", prop("str")), True), (f("first", "no"), None),
    (f("last", prop("tags")), "blue"), (f("isEmpty", 5), True), (f("isEmpty", "a"), False), (f("exists", lit([])), True), (f("coalesce", None, "a", "b"), "a"), (f("ifnull", NONE, "d"), "d"),
    (f("date", "garbage"), None), (f("date", "2024-01-02"), dt.datetime(2024, 1, 2)), (f("year", "2024-01-01"), None), (f("weekday", DAY), 4), (f("hours", DAY), 13), (f("minutes", DAY), 5),
    (f("dateDiff", lit(dt.datetime(2024, 1, 1)), lit(dt.datetime(2024, 1, 1, 1)), "days"), -1), (f("dateDiff", DAY, lit(dt.datetime(2023, 2, 28)), "y"), 1),
    (f("format", DAY, "YYYY/MM/DD MM"), "2024/02/29 MM"), (f("hasTag", "red"), True), (f("hasTag", "#BLUE"), True), (f("inFolder", "x"), True), (f("inFolder", "xx"), False),
    (f("hasExtension", "md"), True), (f("hasLink", "b.MD"), True), (f("tags"), ["#Red", "blue"]), (f("backlinks"), ["x/c.md"]), (f("outlinks"), ["x/B.md"]),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(notes, i):
    assert value(notes, CASES[i][0]) == CASES[i][1]


NUMBERS = {12345678.5: "12345678.5", 0.0001: "0.0001", 1e-7: "1e-7", 1.5e-7: "1.5e-7", 1e21: "1e+21", 3e22: "3e+22", 1e20: "100000000000000000000", 2.0**53: "9007199254740992",
           -0.0: "0", -2.5: "-2.5", 3.0: "3", 1.2345678901234567e-6: "0.0000012345678901234567", 0.1 + 0.2: "0.30000000000000004", 123456789012.25: "123456789012.25", float("inf"): "Infinity"}


def test_texts_of_numbers(spark):
    rows = spark.createDataFrame([(n,) for n in NUMBERS], "n double")
    assert [r[0] for r in rows.select(values.text_of_number(F.col("n"))).collect()] == list(NUMBERS.values())


def test_registry():
    assert len(scalar.names()) == 33
    with pytest.raises(ValueError, match="unknown function"):
        f("nothing", 1)
    with pytest.raises(ValueError, match="takes 2"):
        f("contains", 1)


def test_relative_days():
    now = dt.datetime(2024, 5, 15, 9)
    assert scalar.today(now) is now
    assert relative_day("startOfWeek", now) is not None


def test_variant_properties(spark):
    df = spark.sql("select 'a' as path, parse_json('{\"n\": 4, \"a\": {\"b\": \"x\"}, \"c.d\": \"flat\"}') as properties")
    assert value(df, prop("n", "double") > 3) is True
    assert value(df, prop("a.b")) == "x" and value(df, prop("c.d")) == "flat" and value(df, prop("zz")) is None
