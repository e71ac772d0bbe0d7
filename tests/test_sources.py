import json

import pytest

from arborq.operators.traverse import Rel
from arborq.plans.query import Query
from arborq.sources import frontmatter, notes, sinks, yaml
from arborq.sources.frontmatter import Relation
from arborq.sources.inline import relations_of
from arborq.streaming import maintain

UP = [Relation("up", ("up", "parent"))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("up::[[A]]", [(None, "up", None, "A")]),
        ("UP.Author:: [[A#h|b]]", [(None, "up", "author", "A")]),
        ("[[A]]::up", [("A", "up", None, None)]),
        ("[[A]]::up::[[B]]", [("A", "up", None, "B")]),
        ("up::[[A]] ::[[B]]", [(None, "up", None, "A"), (None, "up", None, "B")]),
        ("up::[[A]] ::-::[[B]]", [(None, "up", None, "A"), ("A", "up", None, "B")]),
        ("[[A]]::up ::[[B]]", [("A", "up", None, "B")]),
        ("[[A]]::up, then ::[[B]]", [("A", "up", None, "B")]),
        ("[[A]]::up and down::[[C]] ::[[B]]", [("A", "up", None, None), (None, "down", None, "C"), (None, "down", None, "B")]),
        ("[[A]]::up ::-::[[B]]", [("A", "up", None, None), (None, "up", None, "B")]),
        ("up::[[A]] up::[[A]]", [(None, "up", None, "A")]),
        ("::[[A]]", []),
        (None, []),
    ],
)
def test_inline(text, want):
    assert [(r["source"], r["relation"], r["label"], r["target"]) for r in relations_of(text)] == want


def test_inline_allowed():
    assert relations_of("up::[[A]] x::[[B]]", frozenset(["x"])) == [{"source": None, "relation": "x", "label": None, "target": "B", "pos": 0}]


def test_front_matter():
    front = {"Up": ["[[A]]", "B|x"], "parent.author": "[[C]]", "deep": {"up": {"role": {"lead": "[[D]]"}}}, "Title": "T", "list": ["a", 1], "n": None, "obj": {"k": 1}}
    got = [(r["relation"], r["label"], r["target"]) for r in frontmatter.relations_of(front, UP)]
    assert got == [("up", None, "A"), ("up", None, "B"), ("up", "role.lead", "D"), ("up", "author", "C")]
    assert frontmatter.properties_of(front, UP) == {"deep": {"up": {"role": {"lead": "[[D]]"}}}, "title": "T", "list": ["a"], "n": None, "obj": {"k": 1}}
    assert frontmatter.relations_of(None, UP) == []


BLOCKS = [
    ('relations:\n  up:\n    - "[[a]]"\n    - "[[b]]"\n  down: "[[c]]"\ntitle: x # note\n', {"relations": {"up": ["[[a]]", "[[b]]"], "down": "[[c]]"}, "title": "x"}),
    ('up:\n- "[[a]]"\n- [[b|c]]\n"quoted key": 3\nn: ~\nf: 1.5\nt: True\n', {"up": ["[[a]]", "[[b|c]]"], "quoted key": 3, "n": None, "f": 1.5, "t": True}),
    ("a: [x, \"y, z\", 3, [[l]]]\nb: {k: v, \"q r\": [1, 2]}\n", {"a": ["x", "y, z", 3, "[[l]]"], "b": {"k": "v", "q r": [1, 2]}}),
    ("x: |\n  l1\n  l2\n\ny: >-\n  a\n  b\nz: 'it''s'", {"x": "l1\nl2\n", "y": "a b", "z": "it's"}),
    ("deep:\n  - name: n1\n    up: q\n  - list:\n      - - 2\n        - 3\n", {"deep": [{"name": "n1", "up": "q"}, {"list": [[2, 3]]}]}),
    ("url: http://x.y/z\nday: 2020-01-01\nlong: [a,\n  b]\nnone:\n", {"url": "http://x.y/z", "day": "2020-01-01", "long": ["a", "b"], "none": None}),
    ("a: [b", None), ("a: 1\n  b: 2", None), ("", None),
]


@pytest.mark.parametrize(("block", "want"), BLOCKS)
def test_front_matter_blocks(block, want):
    try:
        assert yaml.read(block) == want
    except ValueError:
        assert want is None


def test_folder_of_notes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text('---\nrelations:\n  up:\n    - "[[b]]"\ntitle: First note\nrank: 3\n---\nnext::[[c|see]] #tag\n')
    (tmp_path / "sub" / "b.md").write_text("no links, [[missing]]")
    (tmp_path / "c.md").write_text("[[a]]::next::[[b]]")
    g = notes.build(notes.scan(spark, str(tmp_path)))
    explicit = {(r["src"], r["relation"], r["dst"]) for r in g.edges.where("not implied").collect()}
    assert explicit == {("a.md", "up", "sub/b.md"), ("a.md", "next", "c.md"), ("a.md", "next", "sub/b.md")}
    implied = {(r["src"], r["relation"], r["dst"]) for r in g.edges.where("implied").collect()}
    assert implied == {("sub/b.md", "down", "a.md"), ("c.md", "prev", "a.md"), ("sub/b.md", "prev", "a.md")}
    meta = {r["path"]: r for r in g.notes.selectExpr("path", "name", "folder", "tags", "links", "backlinks", "to_json(properties) p").collect()}
    assert meta["a.md"]["tags"] == ["#tag"] and meta["sub/b.md"]["folder"] == "sub" and meta["sub/b.md"]["links"] == []
    assert json.loads(meta["a.md"]["p"]) == {"title": "First note", "rank": 3}
    assert meta["sub/b.md"]["backlinks"] == ["a.md", "c.md"]
    rows = Query("t", Rel("up") >> Rel("down", depth=1)).run(g, spark.createDataFrame([("a.md",)], "path string"))
    assert sinks.outline(rows) == "sub/b.md (up)"
    sinks.write(rows, str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out")).count() == 1


def test_stream_of_changes(spark, tmp_path):
    schema = "owner string, src string, dst string, relation string"

    def parse(fresh):
        return fresh.selectExpr("path owner", "path src", "content dst", "'up' relation")

    state = maintain.EdgeTable(str(tmp_path / "edges"))
    inbox = tmp_path / "in"
    batches = [
        [(1, "upsert", "a", None, "x", None), (2, "upsert", "b", None, "a", None), (3, "upsert", "a", None, "y", None)],
        [(4, "rename", "a", "A", None, None)],
        [(5, "delete", "y", None, None, None), (6, "upsert", "b", None, "z", None)],
    ]
    want = [{("a", "y"), ("b", "a")}, {("A", "y"), ("b", "A")}, {("b", "z")}]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, maintain.CHANGES).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(maintain.CHANGES).parquet(str(inbox))
        query = maintain.maintain(stream, state, parse, spark.createDataFrame([], schema), str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert {(r["src"], r["dst"]) for r in state.read(spark, n + 1).collect()} == want[n]


def test_stream_gives_the_same_table_for_one_batch_and_many(spark):
    schema = "owner string, src string, dst string, relation string"
    parse = lambda fresh: fresh.selectExpr("path owner", "path src", "content dst", "'up' relation")
    rows = [
        (1, "upsert", "x", None, "a", None), (2, "upsert", "a", None, "new", None), (3, "rename", "a", "b", None, None), (4, "upsert", "a", None, "again", None),
        (5, "rename", "b", "c", None, None), (6, "upsert", "w", None, "a", None), (7, "delete", "d", None, None, None), (8, "rename", "d", "e", None, None), (9, "upsert", "d", None, "c", None),
        (10, "upsert", "c", None, "newest", None),
    ]
    old = spark.createDataFrame([("a", "a", "old", "up"), ("d", "d", "k", "up"), ("k", "k", "d", "up"), ("k", "k", "a", "up")], schema)
    edges = lambda df: sorted(tuple(r) for r in df.collect())
    want = {("x", "c"), ("c", "newest"), ("a", "again"), ("w", "a"), ("d", "c"), ("k", "c")}
    one = edges(maintain.applied(old, spark.createDataFrame(rows, maintain.CHANGES), parse))
    assert {r[1:3] for r in one} == want and len(one) == len(want)
    for cuts in ((2, 4, 9), (3, 5)):
        now = old
        for a, b in zip((0, *cuts), (*cuts, 10), strict=True):
            now = spark.createDataFrame(maintain.applied(now, spark.createDataFrame(rows[a:b], maintain.CHANGES), parse).collect(), schema)
        assert edges(now) == one
