"""Ties between the notes of a group against edges for every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborq.operators import groups as G

NOTES = "path string, folder string, tags array<string>, keys array<string>, status string, value double"


def notes_of(spark, seed=0, n=40):
    rng = np.random.default_rng(seed)
    folders = ["/", "a", "a/b", "a/b/c", "d", "d/b", None]
    pick = lambda some: some[int(rng.integers(len(some)))]
    rows = [
        (f"n{i}", pick(folders), [str(t) for t in rng.choice(["x", "y"], int(rng.integers(0, 3)))], pick([["p"], ["p", "q"], [], None]), pick(["s", "t", "lone", None]), pick([None, 1.0, 2.0, 2.0, 5.0]))
        for i in range(n)
    ]
    return spark.createDataFrame([*rows, (None, "a", ["x"], ["p"], "s", 9.0)], NOTES)


def made(spark, notes, which):
    if which == "target":
        return G.same_target(notes.where("status is not null").select(F.col("path").alias("src"), F.col("status").alias("dst"), F.lit("up").alias("relation")), "up")
    return {"siblings": G.folder_siblings, "children": G.folder_children, "tag": lambda n: G.same_tag(n, "x"), "status": lambda n: G.same_property(n, "status"), "keys": lambda n: G.same_property(n, "keys")}[which](notes)


WHICH = ["siblings", "children", "tag", "status", "keys", "target"]


@pytest.mark.parametrize("which", WHICH)
def test_steps_walks_and_sums_equal_those_over_pairs(spark, which):
    notes = notes_of(spark, WHICH.index(which))
    ties = made(spark, notes, which)
    pairs = {(r["src"], r["dst"]) for r in ties.edges("r").collect()}
    assert all(a != b for a, b in pairs)
    if which == "children":
        at = {r["path"]: r["folder"] for r in notes.collect()}
        assert pairs == {(a, b) for a in at for b in at if a and b and at[a] and at[b] and at[a] != at[b] and (at[a] == "/" or at[b].startswith(at[a] + "/"))}
    roots = ["n0", "n1", "n2", "n3", "n4"]
    frontier = spark.createDataFrame([("r", x) for x in roots[:2]] + [("s", x) for x in roots] + [("t", "n5")], "root string, path string")
    got = {(r["root"], r["path"]) for r in ties.step(frontier).collect()}
    assert got == {(f["root"], b) for f in frontier.collect() for a, b in pairs if a == f["path"]}
    for depth in (1, 2, None):
        want = {}
        for root in roots:
            now = {root}
            for hops in range(1, 9 if depth is None else depth + 1):
                now = {b for a, b in pairs if a in now}
                for b in now:
                    want.setdefault((root, b), hops)
        out = ties.reach(spark.createDataFrame([(x,) for x in roots], "path string"), depth).collect()
        assert {(r["root"], r["path"]): r["hops"] for r in out} == want and len(out) == len(want)
    if not ties.once:
        with pytest.raises(ValueError):
            ties.others(notes, "value")
        return
    value = {r["path"]: r["value"] for r in notes.collect()}
    for r in ties.others(notes, "value").collect():
        near = [b for a, b in pairs if a == r["path"]]
        some = [value[b] for b in near if value[b] is not None]
        assert r["count"] == len(near)
        assert [r["sum"], r["least"], r["greatest"]] == ([sum(some), min(some), max(some)] if some else [None] * 3)


def test_a_large_group_stays_linear(spark):
    n = 20_000
    notes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("path"), F.lit("hot").alias("folder"), F.col("id").cast("double").alias("value"))
    ties = G.folder_siblings(notes)
    roots = spark.createDataFrame([("n7",)], "path string")
    assert ties.step(roots.select(F.col("path").alias("root"), "path")).count() == n - 1
    got = ties.reach(roots)
    assert got.count() == n and got.where("root = path").first()["hops"] == 2
    one = ties.others(notes, "value").where("path = 'n0'").first()
    assert (one["count"], one["least"], one["greatest"], one["sum"]) == (n - 1, 1.0, n - 1.0, n * (n - 1) / 2)


def test_no_notes(spark):
    none = notes_of(spark).where("false")
    assert G.folder_siblings(none).step(spark.createDataFrame([("r", "a")], "root string, path string")).count() == 0
    assert G.folder_siblings(none).reach(spark.createDataFrame([("a",)], "path string")).count() == 0
    assert G.folder_children(none).others(none, "value").count() == 0
