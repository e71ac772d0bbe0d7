"""Chains among siblings, ancestors by the first edge, and badges of open properties."""

import numpy as np
from pyspark.sql import functions as F

from arborq.functions.expr import file, prop
from arborq.operators import edges as E
from arborq.operators import tree
from arborq.operators.traverse import Rel
from arborq.plans.query import Chain, Graph, Query

EDGE = "src string, dst string, relation string, label string, implied boolean, implied_from string, ord long"


def plain_order(paths, links):
    """Paths in the order of their ranks, and links (src, dst, ord): the order with chains kept together."""
    at = {p: i for i, p in enumerate(paths)}
    goes = {}
    for a, b, o in links:
        if a in at and b in at and a != b and (a not in goes or (o, at[b]) < goes[a]):
            goes[a] = (o, at[b])
    up = {}
    for a, (_, b) in goes.items():
        up[b] = min(up.get(b, 1 << 60), at[a])

    def head(i):
        seen, steps = [], 0
        while i in up and i not in seen:
            seen.append(i)
            i, steps = up[i], steps + 1
        if i in seen:
            ring = seen[seen.index(i) :]
            least = min(ring)
            start = seen[0]
            n, j = 0, start
            while j != least:
                j, n = up[j], n + 1
            return least, n
        return i, steps

    return [paths[i] for i in sorted(range(len(paths)), key=lambda i: head(i))]


def test_chains_forks_rings_and_long_ones(spark):
    rng = np.random.default_rng(4)
    names = [f"p{i:03d}" for i in range(120)]
    for links in (
        [(names[i], names[i + 1], 1) for i in range(119)][::-1],  # one long chain
        [(names[(7 * i) % 120], names[(7 * i + 7) % 120], 1) for i in range(120)],  # a ring of all
        [(str(rng.choice(names)), str(rng.choice(names)), int(rng.integers(3))) for _ in range(150)],
        [],
    ):
        rows = spark.createDataFrame([("r", None, [0, i], n, i + 1) for i, n in enumerate(names)], "root string, parent_key array<bigint>, key array<bigint>, path string, sibling_rank long")
        got = tree.chained(rows, spark.createDataFrame(links, "src string, dst string, ord long"), [])
        assert [r["path"] for r in got.orderBy("sibling_rank").collect()] == plain_order(names, links)
        assert sorted(r["sibling_rank"] for r in got.collect()) == list(range(1, 121))


def small(spark):
    notes = spark.createDataFrame([("r", None), ("a", 3), ("b", 1), ("c", 2), ("d", 1), ("e", None)], "path string, rank int").withColumn("name", F.col("path"))
    rows = [("r", x, "down", i) for i, x in enumerate("abcde")] + [("a", "b", "next", 1), ("d", "c", "next", 1), ("b", "outside", "next", 0), ("c", "r", "next", 1)]
    return Graph(notes, spark.createDataFrame([(a, b, r, None, False, None, o) for a, b, r, o in rows], EDGE))


def order(spark, *sort):
    graph = small(spark)
    rows = Query("q", Rel("down", depth=1), sort=sort).run(graph, graph.notes.where("path = 'r'").select("path"))
    return "".join(r["path"] for r in rows.orderBy("sibling_rank").collect())


def test_chain_as_a_sort_key(spark):
    assert order(spark, prop("rank")) == "bdcae"
    assert order(spark, Chain(), prop("rank")) == "dcabe"  # d (1) leads c, a (3) leads b
    assert order(spark, prop("rank"), Chain()) == "bdcae"  # ranks differ along the links
    assert order(spark, Chain(("none",)), (prop("rank"), "desc")) == "eacbd"


def test_ancestors_take_the_first_edge(spark):
    rows = [("p", "c", "zed", 1), ("p", "c", "abe", 2), ("q", "c", "abe", 0), ("g", "p", "abe", 5), ("g", "q", "zed", 9)]
    edges = spark.createDataFrame([(a, b, r, None, False, None, o) for a, b, r, o in rows], EDGE)
    got = {(r["path"], r["depth"], r["via"]) for r in E.ancestors(edges, spark.createDataFrame([("c",)], "path string")).collect()}
    assert got == {("p", 1, "zed"), ("q", 1, "abe"), ("g", 2, "zed")}  # q comes before p in the queue


def test_display_of_open_properties(spark):
    notes = spark.createDataFrame(
        [("r", None, "/"), ("a", '{"rank": 3, "status": "open"}', "f"), ("b", '{"tags": ["x", "y"], "rank": 2.50, "done": true, "dims": {"w": 1}, "none": null, "file.x": 1}', "f"), ("c", None, "g"), ("d", "[1]", "g")],
        "path string, json string, folder string",
    ).select("path", F.col("path").alias("name"), "folder", F.parse_json("json").alias("properties"))
    rows = [("r", x, "down", None, False, None, i) for i, x in enumerate("abcd")]
    graph = Graph(notes, spark.createDataFrame(rows, EDGE))
    query = Query("q", Rel("down"), all_properties=True, display=[("status", prop("status")), ("file.folder", file("folder"))])
    got = {r["path"]: [(x["key"], x["value"]) for x in r["display"]] for r in query.run(graph, notes.where("path = 'r'").select("path")).collect()}
    assert got["a"] == [("rank", "3"), ("status", "open"), ("file.folder", "f")]
    assert got["b"] == [("dims", '{"w":1}'), ("done", "true"), ("none", None), ("rank", "2.5"), ("tags", "x, y"), ("status", None), ("file.folder", "f")]
    assert got["c"] == got["d"] == [("status", None), ("file.folder", "g")]
