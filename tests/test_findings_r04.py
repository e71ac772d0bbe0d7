"""One test or more for each finding of round 4: each failed before."""

from pyspark.sql import functions as F

from arborq.operators import adjacency as A
from arborq.operators import common as C
from arborq.operators import groups as G
from arborq.operators import paths as P
from arborq.operators import patterns as M
from arborq.operators import rules as R
from arborq.operators.patterns import Hop, Pattern
from arborq.sources import notes as N


def test_notes_are_parsed_once_and_by_all_tasks(spark, monkeypatch):
    """the edges of notes come from one pass of the parser, dealt to all tasks, though joins and ranks read them several times."""
    rows, tasks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    parse = N.parse_inline

    def counting(df):
        def run(batches):
            n = 0
            for batch in batches:
                n += batch.num_rows
                yield batch
            rows.add(n)
            tasks.add(1 if n else 0)

        out = parse(df)
        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(N, "parse_inline", counting)
    made = spark.createDataFrame([(f"n{i}.md", f"up::[[n{i + 1}]] next::[[n{i + 2}]]") for i in range(40)], "path string, content string").coalesce(1)
    notes = made.selectExpr("path", "content", "cast(null as string) as front_matter")
    got = {(r.src, r.dst, r.relation, r.ord) for r in N.edges_of(notes).collect()}
    assert got == {(f"n{i}.md", f"n{i + 1}.md", "up", 1) for i in range(39)} | {(f"n{i}.md", f"n{i + 2}.md", "next", 2) for i in range(38)}
    assert rows.value == 40 and tasks.value > 1


def kept_rows(monkeypatch, *modules):
    """The rows of each table that an operator keeps on its way."""
    rows = []

    def keeping(df):
        kept = C.anew(df)
        rows.append(kept.count())
        return kept

    for m in modules:
        monkeypatch.setattr(m, "anew", keeping, raising=False)
    return rows


def line(spark, n, users=1):
    return spark.range(users).selectExpr("id as u", f"explode(sequence(1, {n - 1})) as i").selectExpr(
        "concat(u, '/', i) as src", "concat(u, '/', i + 1) as dst", "'x' as relation", "cast(null as string) as label", "false as implied", "cast(null as string) as implied_from", "cast(i as long) as ord"
    )


def test_a_relation_joined_with_itself_keeps_each_pair_once(spark, monkeypatch):
    """the rounds kept all that was known again and again, and made each pair by every note between its ends."""
    rows, n = kept_rows(monkeypatch, R, A), 24
    ring = line(spark, n, 2).unionByName(line(spark, n, 2).where("src = '1/1'").selectExpr(f"'1/{n}' as src", "src as dst", "relation", "label", "implied", "implied_from", "ord"))
    rules = [
        R.Rule("one", Pattern([Hop("a", "x", "b")]), [R.Implies("a", "far", "b")]),
        R.Rule("two", Pattern([Hop("a", "far", "b"), Hop("b", "far", "c")]), [R.Implies("a", "far", "c")]),
    ]
    got = [(r.src, r.dst, r.implied_from) for r in R.with_rules(ring, rules).where("relation = 'far'").collect()]
    want = {(f"0/{a}", f"0/{b}", "one" if b == a + 1 else "two") for a in range(1, n + 1) for b in range(a + 1, n + 1)}
    want |= {(f"1/{a}", f"1/{b}", "one" if b == a % n + 1 else "two") for a in range(1, n + 1) for b in range(1, n + 1)}
    assert set(got) == want and len(got) == len(want)
    assert sum(rows) < 1.5 * len(want)


def test_long_walks_go_on_by_jumps(spark, monkeypatch):
    """a line of n notes took n / 3 rounds."""
    rows, n = kept_rows(monkeypatch, P), 70
    roots = spark.createDataFrame([(f"0/{a}",) for a in range(1, n, 7)], "path string")
    got = [(r.root, r.path, r.hops) for r in P.reach(line(spark, n), roots, P.step("x", way="either").plus()).collect()]
    want = {(f"0/{a}", f"0/{b}", abs(a - b) or 2) for a in range(1, n, 7) for b in range(1, n + 1)}
    assert set(got) == want and len(got) == len(want)
    assert len(rows) < 16


def test_roots_that_meet_in_one_note_walk_on_as_one(spark, monkeypatch):
    """all pairs of the notes below one note were kept, told apart and joined anew."""
    rows, n = kept_rows(monkeypatch, P), 60
    monkeypatch.setattr(P, "MANY", 50, raising=False)
    monkeypatch.setattr(C, "BLOCK", 100, raising=False)
    up = [(f"n{i}", "hub", "up") for i in range(n)] + [("n0", "other", "up"), ("far", "other", "up")]
    edges = spark.createDataFrame([*up, *((b, a, "down") for a, b, _ in up)], "src string, dst string, relation string").selectExpr("*", "cast(null as string) as label")
    roots = spark.createDataFrame([(f"n{i}",) for i in range(n)], "path string")
    for path, own in (((P.step("up") >> P.step("down")).plus(), 2), ((P.step("up") >> P.step("down")).star(), 0)):
        got = [(r.root, r.path, r.hops) for r in P.reach(edges, roots, path).collect()]
        want = {(f"n{a}", f"n{b}", own if a == b else 2) for a in range(n) for b in range(n)} | {(f"n{a}", "far", 2 if a == 0 else 4) for a in range(n)}
        assert set(got) == want and len(got) == len(want)
    assert sum(rows) < n * n


def above_join(df):
    """The operators of a plan down to the first join or union."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return "\n".join(lines[: next(i for i, x in enumerate(lines) if "Join" in x)])


def test_a_step_shuffles_no_pairs(spark, monkeypatch):
    """all pairs of a folder, or of a tag, were told apart by a shuffle, though no two of them were equal."""
    monkeypatch.setattr(C, "BLOCK", 100, raising=False)
    notes = spark.range(60).selectExpr("concat('n', id) as path", "if(id < 50, 'hot', concat('f', id % 2)) as folder", "if(id % 3 = 0, array('t'), array('u')) as tags")
    for ties, group in ((G.folder_siblings(notes), lambda i: "hot" if i < 50 else f"f{i % 2}"), (G.same_tag(notes, "t"), lambda i: "t" if i % 3 == 0 else None)):
        got = ties.step(notes.select(F.col("path").alias("root"), "path"))
        assert "Aggregate" not in above_join(got)
        pairs = [(r.root, r.path) for r in got.collect()]
        assert sorted(pairs) == sorted((f"n{a}", f"n{b}") for a in range(60) for b in range(60) if a != b and group(a) and group(a) == group(b))


def test_a_walk_over_groups_keeps_no_pairs(spark, monkeypatch):
    """what each root meets was kept, once as found, once as seen."""
    rows, n = kept_rows(monkeypatch, G), 40
    monkeypatch.setattr(G, "checkpointed", lambda df: (lambda k: (rows.append(k.count()), k)[1])(C.checkpointed(df)))
    edges = spark.createDataFrame([(f"n{i}", "top", "up") for i in range(n)] + [("lone", "self", "up")], "src string, dst string, relation string")
    ties = G.same_target(edges, "up")
    got = [(r.root, r.path, r.hops) for r in ties.reach(edges.select(F.col("src").alias("path"))).collect()]
    assert sorted(got) == sorted((f"n{a}", f"n{b}", 2 if a == b else 1) for a in range(n) for b in range(n))
    assert sum(rows) < n * n / 2


def test_matches_that_must_differ_are_not_told_apart(spark, monkeypatch):
    """F7 and F8: all pairs of cousins were told apart by a shuffle, though each has one parent."""
    monkeypatch.setattr(C, "BLOCK", 100, raising=False)
    monkeypatch.setattr(M, "WIDE", 4, raising=False)
    up = [(f"c{i}", f"p{i % 4}", "up") for i in range(40)] + [(f"p{i}", f"g{i % 2}", "up") for i in range(4)]
    edges = spark.createDataFrame([*up, *((b, a, "down") for a, b, _ in up)], "src string, dst string, relation string").selectExpr("*", "cast(null as string) as label")
    leaf = {v: spark.createDataFrame([(f"c{i}",) for i in range(40)], "path string") for v in ("file", "cousin")}
    pattern = Pattern([Hop("file", "up", "parent"), Hop("parent", "up", "gp"), Hop("gp", "down", "aunt"), Hop("aunt", "down", "cousin")], [("aunt", "parent"), ("cousin", "file")])
    want = sorted((f"c{a}", f"c{b}") for a in range(40) for b in range(40) if a % 2 == b % 2 and a % 4 != b % 4)
    got = pattern.match(edges, leaf, ["file", "cousin"])
    assert "Aggregate" not in above_join(got) and sorted(map(tuple, got.collect())) == want
    far = Pattern([Hop("file", P.step("up").times(1, 2), "top"), Hop("cousin", "up", "p"), Hop("p", "up", "top")])
    got = far.match(edges, leaf, ["file", "cousin"])
    assert "Aggregate" not in above_join(got) and sorted(map(tuple, got.collect())) == sorted((f"c{a}", f"c{b}") for a in range(40) for b in range(40) if a % 2 == b % 2)
    # with a second parent the same pair comes about twice
    more = edges.unionByName(spark.createDataFrame([("c0", "p2", "up"), ("p2", "c0", "down")], "src string, dst string, relation string").selectExpr("*", "cast(null as string) as label"))
    got = [tuple(r) for r in far.match(more, leaf, ["file", "cousin"]).collect()]
    assert len(got) == len(set(got)) and set(got) == {(f"c{a}", f"c{b}") for a in range(40) for b in range(40) if a % 2 == b % 2}


def test_hops_that_lose_nothing_are_kept_once(spark, monkeypatch):
    """the pairs of every hop were written twice, whether or not the way back dropped any."""
    rows = kept_rows(monkeypatch, M)
    three = [(a, b, r) for i in range(30) for a, b, r in ((f"o{i}", f"p{i}", "has"), (f"p{i}", f"s{i}", "from"), (f"o{i}", f"s{i}", "by"))]
    edges = spark.createDataFrame([*three, *three], "src string, dst string, relation string").selectExpr("*", "cast(null as string) as label")
    pattern = Pattern([Hop("o", "has", "p"), Hop("p", "from", "s"), Hop("o", "by", "s")])
    assert sorted(map(tuple, pattern.match(edges).collect())) == sorted((f"o{i}", f"p{i}", f"s{i}") for i in range(30))
    assert rows[:4] == [30, 30, 30, 30] and len(rows) == 4
    fewer = edges.where("not (relation = 'by' and src = 'o3') and not (relation = 'from' and src = 'p5')")
    assert sorted(map(tuple, pattern.match(fewer).collect())) == sorted((f"o{i}", f"p{i}", f"s{i}") for i in range(30) if i not in (3, 5))
