import random

import pytest
from pyspark.sql import functions as F
from reference_walk import breadth_first, depth_first, promoted

from arborq.functions.expr import file, lit, prop, traversal
from arborq.operators import edges as E
from arborq.operators import implied, traverse, tree
from arborq.operators.implied import Rule
from arborq.operators.traverse import Rel
from arborq.plans import query as Q
from arborq.plans.query import Graph, Query

EDGE = "src string, dst string, relation string, label string, implied boolean, implied_from string, ord long"


def graph(spark, pairs, properties=None, groups=None):
    """pairs: (src, dst, relation[, label]) in the order of their source's list."""
    rows, n = [], {}
    for src, dst, relation, *label in pairs:
        n[src] = n.get(src, 0) + 1
        rows.append((src, dst, relation, label[0] if label else None, False, None, n[src]))
    names = sorted({p for r in pairs for p in r[:2]} | set(properties or {}))
    notes = [(p, p.split("/")[-1].removesuffix(".md"), "/", 1000, [], [], *(properties or {}).get(p, (None, None))) for p in names]
    schema = "path string, name string, folder string, size long, tags array<string>, links array<string>, level double, kind string"
    return Graph(spark.createDataFrame(notes, schema), spark.createDataFrame(rows, EDGE), groups or {})


def roots(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def paths(rows):
    return [r["path"] for r in rows.orderBy("root", "key").collect()]


def routes(rows):
    return [tuple(r["traversal_path"]) for r in rows.orderBy("root", "key").collect()]


def test_random_graphs_match_brute_force(spark):
    r = random.Random(5)
    for _ in range(4):
        names = [f"n{i}" for i in range(7)]
        adjacency = {a: r.sample([b for b in names if b != a], r.randrange(0, 4)) for a in names}
        bad = {n for n in names[1:] if r.random() < 0.2}
        g = graph(spark, [(a, b, "down") for a in names for b in adjacency[a]] or [("n0", "n1", "up")], {n: (1.0 if n in bad else 0.0, None) for n in names})
        prune = prop("level").eq(1.0)
        assert routes(Query("t", Rel("down"), prune=prune).run(g, roots(spark, "n0"))) == depth_first(adjacency, "n0", pruned=bad)
        assert routes(Query("t", Rel("down", depth=2)).run(g, roots(spark, "n0"))) == depth_first(adjacency, "n0", 2)
        assert paths(Query("t", Rel("down", flatten=True), prune=prune & traversal("depth").eq(1)).run(g, roots(spark, "n0"))) == breadth_first(adjacency, "n0", bad)
        where = Query("t", Rel("down", depth=3), where=~prune).run(g, roots(spark, "n0"))
        all_rows = {tuple(x["key"]): tuple(x["traversal_path"]) for x in Query("t", Rel("down", depth=3)).run(g, roots(spark, "n0")).collect()}
        got = [(tuple(x["traversal_path"]), all_rows[tuple(x["parent_key"])] if x["parent_key"] else None) for x in where.orderBy("key").collect()]
        assert got == promoted(depth_first(adjacency, "n0", 3), lambda n: n not in bad)


def test_diamond_in_tree_and_flat(spark):
    g = graph(spark, [("r", "a", "down"), ("r", "b", "down"), ("a", "c", "down"), ("b", "c", "down")])
    assert paths(Query("t", Rel("down")).run(g, roots(spark, "r"))) == ["a", "c", "b", "c"]
    flat = Query("t", Rel("down", flatten=True)).run(g, roots(spark, "r"))
    assert paths(flat) == ["a", "b", "c"]
    assert {(x["depth"], x["parent"], x["parent_key"]) for x in flat.collect()} == {(1, "r", None)}


def test_depth_zero(spark):
    g = graph(spark, [("a", "b", "down"), ("b", "c", "down")])
    assert paths(Query("t", Rel("down", depth=0)).run(g, roots(spark, "a"))) == []
    assert paths(Query("t", Rel("down", depth=0, flatten=True)).run(g, roots(spark, "a"))) == ["b"]


def test_partial_flatten(spark):
    g = graph(spark, [("a", "b", "down"), ("b", "c", "down"), ("c", "d", "down"), ("d", "e", "down")])
    rows = {x["path"]: x for x in Query("t", Rel("down", flatten=2)).run(g, roots(spark, "a")).collect()}
    assert rows["d"]["parent_key"] == rows["e"]["parent_key"] == rows["c"]["key"]
    assert rows["c"]["parent_key"] == rows["b"]["key"] and rows["b"]["parent_key"] is None


def test_labels_filter_the_first_relation(spark):
    g = graph(spark, [("book", "ann", "up", "author"), ("book", "set", "up", "series"), ("ann", "x", "up")])
    assert paths(Query("t", Rel("up", label="author", depth=1)).run(g, roots(spark, "book"))) == ["ann"]
    assert paths(Query("t", Rel("up", label="author", depth=1) >> Rel("up", label="none")).run(g, roots(spark, "book"))) == ["ann", "x"]


def test_chains(spark):
    pairs = [("son", "dad", "up"), ("dad", "gran", "up"), ("gran", "aunt", "same"), ("dad", "uncle", "same")]
    g = graph(spark, pairs, groups={"Siblings": Query("Siblings", Rel("same"), where=lit(False))})
    start = roots(spark, "son")
    assert paths(Query("t", Rel("up") >> Rel("same")).run(g, start)) == ["dad", "gran", "aunt"]
    assert paths(Query("t", Rel("up", depth=1) >> Rel("same")).run(g, start)) == ["dad", "uncle"]
    assert paths(Query("t", Rel("up") >> "Siblings").run(g, start)) == ["dad", "gran", "aunt"]
    assert paths(Query("t", Rel("up") >> "Nobody").run(g, start)) == ["dad", "gran"]
    assert paths(Query("t", Rel("up") >> Query("", Rel("same"), where=file("name").eq("no"))).run(g, start)) == ["dad", "gran"]
    rows = {x["path"]: x for x in Query("t", Rel("up") >> Rel("same")).run(g, start).collect()}
    assert rows["aunt"]["depth"] == 1 and rows["aunt"]["traversal_path"] == ["gran", "aunt"] and rows["aunt"]["parent_key"] == rows["gran"]["key"]
    assert paths(Query("t", Rel("same") >> Rel("up")).run(g, roots(spark, "nobody"))) == []


def test_chain_does_not_come_back(spark):
    g = graph(spark, [("a", "b", "down"), ("b", "a", "next"), ("b", "c", "next")])
    assert paths(Query("t", Rel("down") >> Rel("next")).run(g, roots(spark, "a"))) == ["b", "c"]


def test_flat_walk_appends_its_chain(spark):
    g = graph(spark, [("r", "a", "down"), ("r", "b", "down"), ("a", "x", "next")])
    rows = Query("t", Rel("down", flatten=True) >> Rel("next")).run(g, roots(spark, "r"))
    assert sorted(paths(rows)) == ["a", "b", "x"] and all(x["parent_key"] is None for x in rows.collect())


def test_when_and_unknown_names(spark):
    g = graph(spark, [("a", "b", "down")], {"a": (3.0, "x")})
    assert paths(Query("t", Rel("down"), when=prop("level") > 2).run(g, roots(spark, "a"))) == ["b"]
    assert paths(Query("t", Rel("down"), when=traversal("depth").eq(1)).run(g, roots(spark, "a"))) == []
    q = Query("t", Rel("nowhere") >> "Nobody")
    assert paths(q.run(g, roots(spark, "a"))) == [] and q.problems(g) == ["UNKNOWN_RELATION nowhere", "UNKNOWN_GROUP Nobody"]


def test_sort_puts_nulls_last_then_first(spark):
    props = {"a": (2.0, None), "b": (None, None), "c": (1.0, None), "d": (None, None)}
    g = graph(spark, [("r", x, "down") for x in "dbac"], props)
    order = lambda way: [x["path"] for x in Query("t", Rel("down"), sort=[(prop("level"), way)]).run(g, roots(spark, "r")).orderBy("sibling_rank").collect()]
    assert order("asc") == ["c", "a", "b", "d"]
    assert order("desc") == ["b", "d", "a", "c"]


def test_aggregates(spark):
    pairs = [("p", "a", "down"), ("p", "b", "down"), ("q", "c", "down"), ("a", "z", "down"), ("b", "z", "down")]
    g = graph(spark, pairs, {"a": (10.0, "done"), "b": (None, "done"), "c": (5.0, "open"), "z": (1.0, None), "e": (None, None)})
    down = Rel("down")
    exprs = {
        "n": Q.count(down), "sum": Q.total(down, prop("level")), "avg": Q.average(down, prop("level")), "min": Q.least(down, prop("kind")), "max": Q.greatest(down, prop("level")),
        "any": Q.any_of(down, prop("kind").eq("done")), "all": Q.all_of(down, prop("level") > 0), "list": Q.paths(down),
    }
    rows, row = g.resolve(roots(spark, "p", "q", "e"), *exprs.values())
    got = {x["path"]: x for x in rows.select("path", *(e.value(row).col.alias(k) for k, e in exprs.items())).collect()}
    assert tuple(got["p"])[1:] == (4, 12.0, 4.0, "done", 10.0, True, False, ["a", "z", "b", "z"])
    assert tuple(got["e"])[1:] == (0, 0.0, None, None, None, False, True, [])
    assert got["q"]["n"] == 1 and got["q"]["any"] is False


def test_aggregate_inside_prune(spark):
    g = graph(spark, [("r", "a", "down"), ("r", "b", "down"), ("a", "x", "down"), ("a", "y", "down"), ("b", "z", "down")])
    assert paths(Query("t", Rel("down"), prune=Q.count(Rel("down", depth=1)) > 1).run(g, roots(spark, "r"))) == ["b", "z"]


@pytest.mark.parametrize(
    ("direction", "want"),
    [
        ("forward", {("a", "t"), ("b", "t")}), ("reverse", {("t", "a"), ("t", "b")}), ("both", {("a", "t"), ("b", "t"), ("t", "a"), ("t", "b")}), ("sibling", {("a", "b"), ("b", "a")}),
    ],
)
def test_implied_directions(spark, direction, want):
    g = graph(spark, [("a", "t", "up"), ("b", "t", "up")])
    rows = implied.with_implied(g.edges, [Rule("up", "x", direction)]).where("implied").collect()
    assert {(r["src"], r["dst"]) for r in rows} == want
    assert {(r["relation"], r["label"], r["implied_from"]) for r in rows} == {("x", None, "up")}


def test_explicit_edges_suppress_implied_ones(spark):
    g = graph(spark, [("a", "t", "up"), ("t", "a", "down", "given")])
    rows = implied.with_implied(g.edges, [Rule("up", "down", "reverse"), Rule("down", "up", "reverse")])
    assert rows.count() == 2 and rows.where("implied").isEmpty()


def test_implied_edges_do_not_feed_rules(spark):
    g = graph(spark, [("a", "b", "up")])
    rows = implied.with_implied(g.edges, [Rule("up", "down", "reverse"), Rule("down", "deep", "forward")])
    assert {r["relation"] for r in rows.collect()} == {"up", "down"}


def test_edge_upkeep(spark):
    g = graph(spark, [("a", "b", "up"), ("b", "c", "up"), ("c", "a", "next")])
    renamed = E.rename(g.edges, spark.createDataFrame([("b", "B")], "old string, new string"))
    assert {(r["src"], r["dst"]) for r in renamed.collect()} == {("a", "B"), ("B", "c"), ("c", "a")}
    assert {(r["src"], r["dst"]) for r in E.delete(g.edges, roots(spark, "b")).collect()} == {("c", "a")}
    found = {(r["path"], r["depth"], r["via"]) for r in E.ancestors(g.edges, roots(spark, "c")).collect()}
    assert found == {("b", 1, "up"), ("a", 2, "up")}
    assert {(r["path"], r["depth"]) for r in E.ancestors(g.edges, roots(spark, "c"), ["next"]).collect()} == set()


def test_merge_cluster_invert(spark):
    pairs = [("r", "m", "up"), ("r", "d", "up"), ("m", "g", "up"), ("d", "g", "up"), ("r", "m", "near", "kin")]
    g = graph(spark, pairs)
    merged = tree.merge_by_path(Query("t", Rel("up"), Rel("near")).run(g, roots(spark, "r")))
    got = {tuple(x["chain"]): x["relations"] for x in merged.collect()}
    assert got == {("m",): ["near.kin", "up"], ("d",): ["up"], ("m", "g"): ["up"], ("d", "g"): ["up"]}
    same = tree.merge_by_path(Query("t", Rel("up")).run(g, roots(spark, "r")))
    clusters = {tuple(x["chain"]): x["members"] for x in tree.cluster(same).collect()}
    assert clusters[("m",)] == clusters[("d",)] == 2
    chains = {(tuple(x["tip"]), x["place"]): x["path"] for x in tree.invert(same).collect()}
    assert chains == {(("m", "g"), 0): "g", (("m", "g"), 1): "m", (("d", "g"), 0): "g", (("d", "g"), 1): "d"}


def test_merge_keeps_what_the_first_had(spark):
    up = [("r", "a", "up"), ("r", "b", "near"), ("r", "a", "near"), ("a", "c", "up")]
    g = graph(spark, up, {"a": (7.0, "k")})
    edges = g.edges.withColumn("implied", F.col("relation") == "up").withColumn("implied_from", F.when(F.col("relation") == "up", F.lit("down")))
    rows = Query("t", Rel("up"), Rel("near"), display=[("level", prop("level"))]).run(Graph(g.notes, edges), roots(spark, "r"))
    merged = {tuple(x["chain"]): x for x in tree.merge_by_path(rows).collect()}
    assert merged["a",]["implied"] is False and merged["a",]["implied_from"] is None and merged["a", "c"]["implied_from"] == "down"
    assert merged["a",]["kept"]["display"][0]["value"] == "7"


def test_subgroups_and_direction(spark):
    g = graph(spark, [("r", x, "down") for x in ("a", "b", "z")] + [(x, y, "down") for x in ("a", "b") for y in ("c", "d")] + [("s", "a", "up"), ("a", "q", "up")])
    rows = Query("t", Rel("down")).run(g, roots(spark, "r"))
    shown = {(tuple(x["chain"]), x["members"]) for x in tree.subgroups(tree.cluster(tree.merge_by_path(rows))).collect()}
    assert shown == {(("a",), 2), (("b",), 2), (("z",), 1), (("a", "c"), 2), (("a", "d"), 2)}
    both = Query("t", Rel("up"), Rel("down")).run(g, roots(spark, "r", "s"))
    placed = {(x["root"], tuple(x["tip"]), x["place"]): x["path"] for x in tree.as_shown(both, {"up": "ascending"}).collect()}
    assert placed["s", ("a", "q"), 0] == "q" and placed["s", ("a", "q"), 1] == "a" and placed["r", ("a", "c"), 0] == "a" and placed["r", ("a", "c"), 1] == "c"


def test_deep_walks_have_no_level_limit(spark, monkeypatch):
    monkeypatch.setattr(traverse, "FOLDED", 3)
    line = [(f"n{i}", f"n{i + 1}", "next") for i in range(11)]
    g = graph(spark, line)
    assert len(paths(Query("t", Rel("next")).run(g, roots(spark, "n0")))) == 11
    assert len(paths(Query("t", Rel("next", flatten=True)).run(g, roots(spark, "n0")))) == 11
    assert E.ancestors(g.edges, roots(spark, "n11")).count() == 11


def test_ranked_spreads_one_large_group(spark):
    from arborq.operators.common import ranked

    df = spark.range(5000).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 5000).alias("v"))
    rows = ranked(df, ["g"], [F.col("v").asc()], "rank").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 5001)) and all(r["rank"] == r["v"] + 1 for r in rows)
