"""Paths with quantifiers, patterns with variables and rules, against plain Python versions on small graphs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborq.operators.adjacency import index
from arborq.operators.paths import Automaton, reach, step
from arborq.operators.patterns import Hop, Pattern, conditions
from arborq.operators.rules import Implies, Rule, strata, with_rules

EDGE = "src string, dst string, relation string, label string, implied boolean, implied_from string, ord long"


def table(spark, rows):
    return spark.createDataFrame([(a, b, r, None, False, None, i) for i, (a, b, r) in enumerate(rows)], EDGE)


def paths_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def random_rows(seed, notes=9, edges=26, relations="xyz"):
    rng = np.random.default_rng(seed)
    return [(f"n{rng.integers(notes)}", f"n{rng.integers(notes)}", str(rng.choice(list(relations)))) for _ in range(edges)]


def words(path, most):
    """All relation words of up to `most` steps that a path allows, each step as (relation, way)."""
    if path.kind == "step":
        return {((path.relation, w),) for w in (("out", "in") if path.way == "either" else (path.way,))}
    if path.kind == "either":
        return set().union(*(words(p, most) for p in path.parts))
    if path.kind == "then":
        return {a + b for a in words(path.parts[0], most) for b in words(path.parts[1], most) if len(a + b) <= most}
    body, out, now = words(path.parts[0], most), set(), {()}
    for n in range((path.high if path.high is not None else most) + 1):
        if n >= path.low:
            out |= now
        now = {a + b for a in now for b in body if len(a + b) <= most}
    return out


def plain_reach(rows, roots, path, most=7):
    out = {}
    for root in roots:
        for word in words(path, most):
            at = {root}
            for relation, way in word:
                at = {b if way == "out" else a for a, b, r in rows for here in at if r == relation and (a if way == "out" else b) == here}
            for note in at:
                out[root, note] = min(out.get((root, note), 99), len(word))
    return out


x, y, z = step("x"), step("y"), step("z", way="in")
PATHS = [x.plus(), x.star(), x.opt() >> y, (x >> y).plus(), (x | z).times(2, 3), step("y", way="either").plus(), x.times(2, None) >> z.opt(), (x.opt() >> y.star()).times(1, 2), x.times(3, 3), z.times(0, 2)]


@pytest.mark.parametrize("n", range(len(PATHS)))
def test_reach_equals_walks(spark, n):
    rows = random_rows(n)
    roots = ["n0", "n3", "n8", "nowhere"]
    got = {(r["root"], r["path"]): r["hops"] for r in reach(table(spark, rows), paths_of(spark, [*roots, "n0", None]), PATHS[n]).collect()}
    want = plain_reach(rows, roots, PATHS[n])
    assert {k: v for k, v in got.items() if v <= 7} == want


def test_reach_labels_cycles_and_nothing(spark):
    edges = table(spark, [("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("c", "d", "x"), (None, "a", "x"), ("d", None, "x")]).withColumn("label", F.when(F.col("src") == "c", "l"))
    got = {(r["path"], r["hops"]) for r in reach(edges, paths_of(spark, ["a"]), x.plus()).collect()}
    assert got == {("b", 1), ("c", 2), ("a", 3), ("d", 3)}
    assert {r["path"] for r in reach(edges, paths_of(spark, ["a"]), x >> x >> step("x", "l")).collect()} == {"a", "d"}
    assert reach(edges, paths_of(spark, ["a"]), step("none").plus()).count() == 0
    assert [r["path"] for r in reach(edges.where("false"), paths_of(spark, ["a"]), x.star()).collect()] == ["a"]
    assert reach(edges, paths_of(spark, ["a"]).where("false"), x.star()).count() == 0
    for bad in (lambda: x.times(2, 1), lambda: x.times(-1, 2), lambda: step("x", way="up")):
        with pytest.raises(ValueError):
            bad()


def test_automaton():
    assert Automaton.of(x.times(2, 5)).longest() == 5 and Automaton.of(x >> y.star()).longest() is None
    assert 0 in Automaton.of(x.star()).ends and 0 not in Automaton.of(x.plus()).ends
    with pytest.raises(ValueError):
        Automaton.of(x.times(1, 5000))


def test_index_moves_the_other_side_alone(spark):
    rows = [("hub", f"n{i}", "x") for i in range(50)] + [("a", "b", "x")]
    graph = index(table(spark, rows), {"x"}, heavy=8)
    assert graph.rows.where(F.col("place").startswith("0\0x\0hub")).select("place").distinct().count() == 7
    asked = paths_of(spark, ["hub", "a", "none"]).select(F.col("path").alias("at"), F.lit(0).alias("way"), F.lit("x").alias("relation"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = graph.neighbours(asked)
        assert joined.count() == 51
        plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = max(i for i, line in enumerate(plan) if "Scan ExistingRDD" in line and "place" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    join = max(i for i, line in enumerate(plan[:scan]) if "Join" in line and "place" in line)
    above = [line for i, line in enumerate(plan[join + 1 : scan]) if all(depth(x) > depth(line) for x in plan[join + 2 + i : scan + 1])]
    assert not any("Exchange" in line or "Sort" in line for line in above), above


def plain_matches(rows, hops, distinct, within):
    notes = sorted({n for a, b, _ in rows for n in (a, b)})
    names = list(dict.fromkeys(v for h in hops for v in (h.start, h.end)))
    have = set(rows)
    out = set()
    for values in itertools.product(notes, repeat=len(names)):
        at = dict(zip(names, values, strict=True))
        tied = all((at[h.start], at[h.end], h.via) in have or (h.undirected and (at[h.end], at[h.start], h.via) in have) for h in hops)
        if tied and all(at[p] != at[q] for p, q in distinct) and all(at[v] in allowed for v, allowed in within.items()):
            out.add(values)
    return out


PATTERNS = [
    ([Hop("a", "x", "b"), Hop("b", "y", "c")], [], {}),
    ([Hop("a", "x", "b"), Hop("b", "x", "c"), Hop("a", "x", "c")], [], {}),
    ([Hop("a", "x", "b"), Hop("b", "x", "c"), Hop("c", "x", "a")], [("a", "b")], {}),
    ([Hop("a", "x", "b"), Hop("b", "x", "c"), Hop("c", "x", "d"), Hop("d", "x", "a")], [("a", "c"), ("b", "d")], {}),
    ([Hop("p", "x", "a"), Hop("p", "x", "b")], [("a", "b")], {"a": {"n1", "n2", "n3"}}),
    ([Hop("a", "x", "b", True), Hop("b", "y", "c", True), Hop("a", "x", "a")], [], {}),
    ([Hop("a", "x", "b"), Hop("a", "y", "b")], [], {}),
    ([Hop("a", "x", "a")], [], {}),
]


@pytest.mark.parametrize("n", range(len(PATTERNS)))
def test_pattern_equals_trying_all(spark, n):
    hops, distinct, within = PATTERNS[n]
    rows = random_rows(20 + n, 7, 36, "xxy")
    pattern = Pattern(hops, distinct, heavy=3)
    limits = {v: paths_of(spark, sorted(allowed)) for v, allowed in within.items()}
    edges = table(spark, [*rows, (None, "n1", "x")])
    got = [tuple(r) for r in pattern.match(edges, limits).collect()]
    want = plain_matches(rows, hops, distinct, within)
    assert len(got) == len(set(got)) and set(got) == want
    first = pattern.variables[0]
    assert {r[0] for r in pattern.match(edges, limits, [first]).collect()} == {w[0] for w in want}


def test_triangles_beside_a_hub_make_no_pairs_of_its_edges(spark):
    n = 300
    rows = [(f"l{i}", "hub", "x") for i in range(n)] + [("hub", f"r{i}", "x") for i in range(n)] + [("l1", "r2", "x"), ("l3", "r3", "x")]
    pattern = Pattern([Hop("a", "x", "b"), Hop("b", "x", "c"), Hop("a", "x", "c")], heavy=50)
    met = []
    plain = pattern._proposed

    def counted(*args):
        out = plain(*args)
        met.append(out.count())
        return out

    object.__setattr__(pattern, "_proposed", counted)
    assert {tuple(r) for r in pattern.match(table(spark, rows)).collect()} == {("l1", "hub", "r2"), ("l3", "hub", "r3")}
    assert sum(met) <= 4 * n  # n * n pairs meet at the hub


def test_pattern_errors_and_conditions(spark):
    with pytest.raises(ValueError):
        Pattern([])
    with pytest.raises(ValueError):
        Pattern([Hop("a", "x", "b")], [("a", "c")])
    edges = table(spark, [("a", "b", "x"), ("c", "d", "y")])
    with pytest.raises(ValueError):
        Pattern([Hop("a", "x", "b"), Hop("c", "y", "d")]).match(edges)
    assert Pattern([Hop("a", "x", "b"), Hop("b", "none", "c")]).match(edges).count() == 0
    notes = spark.createDataFrame([("a", 1), ("b", 5), ("c", None)], "path string, rank int")
    assert Pattern([Hop("a", "x", "b")]).match(edges, conditions(notes, b=F.col("rank") > 4)).count() == 1


def closure(pairs):
    pairs = set(pairs)
    while more := {(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs:
        pairs |= more
    return pairs


def test_rules_reach_a_fixpoint(spark):
    rows = random_rows(50, 10, 16, "x")
    base = {(a, b) for a, b, _ in rows}
    linear = [Rule("one", Pattern([Hop("a", "x", "b")]), [Implies("a", "t", "b")]), Rule("two", Pattern([Hop("a", "x", "b"), Hop("b", "t", "c")]), [Implies("a", "t", "c")])]
    square = [linear[0], Rule("two", Pattern([Hop("a", "t", "b"), Hop("b", "t", "c")]), [Implies("a", "t", "c")])]
    path = [Rule("all", Pattern([Hop("a", x.plus(), "b")]), [Implies("a", "t", "b")])]
    for rules in (linear, square, path):
        got = with_rules(table(spark, rows), rules)
        assert {(r["src"], r["dst"]) for r in got.where("relation = 't'").collect()} == closure(base)
        assert got.where("implied").select("src", "dst", "relation").distinct().count() == got.where("implied").count() and got.where("not implied").count() == len(rows)


def test_rules_of_a_ring_and_references(spark):
    edges = table(spark, [("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), ("a", "b", "even")])
    rules = [
        Rule("odd", Pattern([Hop("p", "x", "q")]), [Implies("p", "odd", "q")]),
        Rule("even", Pattern([Hop("p", "x", "q"), Hop("q", "odd", "r")]), [Implies("p", "even", "r")]),
        Rule("odd_more", Pattern([Hop("p", "x", "q"), Hop("q", "even", "r")]), [Implies("p", "odd", "r")]),
        Rule("back", "odd", [Implies("q", "back", "p"), Implies("p", "tied", "q", both=True)]),
    ]
    got = {(r["src"], r["dst"], r["relation"], r["implied"]) for r in with_rules(edges, rules).collect()}
    want = {("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x")}
    odd, even = {("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")}, {("a", "c"), ("b", "d")}
    assert {g[:3] for g in got} == want | {(*p, "odd") for p in odd} | {(*p, "even") for p in even | {("a", "b")}} | {(b, a, "back") for a, b, _ in want} | {
        (*p, "tied") for a, b, _ in want for p in ((a, b), (b, a))
    }
    assert ("a", "b", "even", False) in got and ("a", "b", "even", True) not in got
    assert [sorted(r.name for r in g) for g in strata(rules[:3])] == [["odd"], ["even", "odd_more"]] or len(strata(rules[:3])) == 2
    for bad in ([Rule("a", "b", []), Rule("b", "a", [])], [Rule("a", "none", [])], [rules[0], rules[0]], [Rule("a", Pattern([Hop("p", "x", "q")]), [Implies("p", "t", "s")])]):
        with pytest.raises(ValueError):
            with_rules(edges, bad)
    assert with_rules(edges, []).count() == 4
