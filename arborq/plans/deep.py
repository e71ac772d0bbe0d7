"""Registered queries of paths with quantifiers, patterns with variables, rules over rules, chains of siblings and open properties, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.operators.paths import Path, reach, step
from arborq.operators.patterns import Hop, Pattern
from arborq.operators.rules import Implies, Rule, with_rules
from arborq.functions.expr import file, prop
from arborq.operators import edges as E
from arborq.operators import groups as G
from arborq.operators.traverse import Rel
from arborq.plans.catalog import GRAPH, NUMBERED, SO, SR, walk_sql
from arborq.plans.query import Chain, Graph, Query
from arborq.sources import tables

Call = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Call] = {}
SQL: dict[str, str] = {}


def add(name: str, call: Call, sql: str) -> None:
    QUERIES[name], SQL[name] = call, sql


# ---- paths with quantifiers ----


def reached(name: str, start: str, path: Path, sql: str, source: Callable[[SparkSession, str], Graph] = tables.hierarchy) -> None:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = source(spark, sf_dir)
        return reach(graph.edges, graph.notes.where(start).select("path"), path)

    add(name, call, sql)


def closure_sql(relation: str, start: str) -> str:
    """A recursive CTE of all walks along a relation: root, path, hops (0 for the root)."""
    return f"""{GRAPH}, hops AS (
  SELECT path AS root, path, 0 AS hops FROM notes WHERE {start}
  UNION ALL SELECT h.root, e.dst, h.hops + 1 FROM hops h JOIN edges e ON e.src = h.path AND e.relation = '{relation}')"""


UP, DOWN = step("up"), step("down")
reached("path_plus", "folder = 'orders'", UP.plus(), f"{closure_sql('up', chr(34) + 'folder' + chr(34) + ' = ' + repr('orders'))} SELECT root, path, hops::INTEGER AS hops FROM hops WHERE hops > 0")
reached("path_star_with_start", "folder = 'customer'", UP.star(), f"{closure_sql('up', 'folder = ' + repr('customer'))} SELECT root, path, hops::INTEGER AS hops FROM hops")
reached("path_range", "folder = 'region'", DOWN.times(2, 3), f"{closure_sql('down', 'folder = ' + repr('region'))} SELECT root, path, hops::INTEGER AS hops FROM hops WHERE hops BETWEEN 2 AND 3")
reached("path_exactly", "folder = 'region'", DOWN.times(2, 2), f"{closure_sql('down', 'folder = ' + repr('region'))} SELECT root, path, hops::INTEGER AS hops FROM hops WHERE hops = 2")
reached(
    "path_optional", "folder = 'orders'", UP >> UP.opt(), f"{closure_sql('up', 'folder = ' + repr('orders'))} SELECT root, path, hops::INTEGER AS hops FROM hops WHERE hops BETWEEN 1 AND 2"
)
reached(
    "path_label_then_any", "folder = 'orders'", step("up", "1-urgent") >> UP.star(),
    f"{closure_sql('up', 'folder = ' + repr('orders'))} SELECT root, path, hops::INTEGER AS hops FROM hops WHERE hops > 0 AND root IN (SELECT src FROM edges WHERE relation = 'up' AND label = '1-urgent')",
)
# The round (up >> down) comes back to every note with the same parent, the supplier itself included, in two steps and no new one later.
reached(
    "path_repeated_group", "folder = 'supplier'", (UP >> DOWN).plus(),
    f"{GRAPH} SELECT a.src AS root, b.dst AS path, 2 AS hops FROM edges a JOIN edges b ON b.src = a.dst AND a.relation = 'up' AND b.relation = 'down' WHERE a.src LIKE 'supplier/%'",
)
reached(
    "path_sequence_plus", "type = 'signup'", step("next").plus(), f"""{NUMBERED}
SELECT a.path AS root, b.path AS path, (b.i - a.i)::INTEGER AS hops FROM numbered a JOIN numbered b ON b.user_id = a.user_id AND b.i > a.i AND a.event_type = 'signup'""", tables.sequences,
)
# Either way along a line: every note of it, and the start itself by going out and back.
reached(
    "path_either_way", "type = 'signup'", step("next", way="either").plus(), f"""{NUMBERED}, sizes AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT a.path AS root, b.path AS path, CASE WHEN a.i = b.i THEN 2 ELSE abs(b.i - a.i) END::INTEGER AS hops
FROM numbered a JOIN numbered b ON b.user_id = a.user_id AND a.event_type = 'signup' JOIN sizes s ON s.user_id = a.user_id AND s.n > 1""", tables.sequences,
)

# ---- patterns with variables ----


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of line items: order `has` part, part `from` supplier, order `by` supplier; as often as items tie them, which a pattern counts once."""
    l = tables.read(spark, sf_dir, "lineitem")  # noqa: E741
    order, part, supplier = (tables.path(kind, F.col(f"l_{kind}key")) for kind in ("order", "part", "supp"))
    ties = F.array(*(F.struct(a.alias("src"), b.alias("dst"), F.lit(r).alias("relation")) for a, b, r in ((order, part, "has"), (part, supplier, "from"), (order, supplier, "by"))))
    made = l.select(F.explode(ties).alias("e")).select("e.*")
    return made.select("src", "dst", "relation", F.lit(None).cast("string").alias("label"), F.lit(False).alias("implied"), F.lit(None).cast("string").alias("implied_from"), F.lit(1).cast("long").alias("ord"))


def matched(name: str, pattern: Pattern, sql: str, select: list[str] | None = None, within: Callable[[Graph], dict] | None = None) -> None:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = tables.hierarchy(spark, sf_dir)
        return pattern.match(graph.edges, within(graph) if within else None, select)

    add(name, call, sql)


_UP = "(SELECT src, dst FROM edges WHERE relation = 'up')"
matched(
    "pattern_aunts", Pattern([Hop("file", "up", "parent"), Hop("parent", "up", "gp"), Hop("gp", "down", "aunt")], [("aunt", "parent")]),
    f"{GRAPH}, u AS {_UP} SELECT DISTINCT a.src AS file, c.src AS aunt FROM u a JOIN u b ON b.src = a.dst JOIN u c ON c.dst = b.dst AND c.src <> a.dst WHERE a.src NOT LIKE 'orders/%'",
    ["file", "aunt"], lambda g: {"file": g.notes.where("folder <> 'orders'")},
)
matched(
    "pattern_cousins", Pattern([Hop("file", "up", "parent"), Hop("parent", "up", "gp"), Hop("gp", "down", "aunt"), Hop("aunt", "down", "cousin")], [("aunt", "parent"), ("cousin", "file")]),
    f"""{GRAPH}, u AS {_UP} SELECT DISTINCT a.src AS file, d.src AS cousin FROM u a JOIN u b ON b.src = a.dst JOIN u c ON c.dst = b.dst AND c.src <> a.dst JOIN u d ON d.dst = c.src AND d.src <> a.src
JOIN notes n ON n.path = a.src AND n.folder = 'supplier' JOIN notes m ON m.path = d.src AND m.folder = 'supplier'""",
    ["file", "cousin"], lambda g: {v: g.notes.where("folder = 'supplier'") for v in ("file", "cousin")},
)
matched(
    "pattern_with_path", Pattern([Hop("file", step("up").times(1, 2), "top"), Hop("supplier", "up", "nation"), Hop("nation", "up", "top")]),
    f"""{GRAPH}, u AS {_UP}, far AS (SELECT src AS file, dst AS top FROM u UNION SELECT a.src, b.dst FROM u a JOIN u b ON b.src = a.dst)
SELECT DISTINCT f.file, s.src AS supplier FROM far f JOIN u n ON n.dst = f.top JOIN u s ON s.dst = n.src AND s.src LIKE 'supplier/%' WHERE f.file LIKE 'nation/%' OR f.file LIKE 'supplier/%'""",
    ["file", "supplier"], lambda g: {"file": g.notes.where("folder in ('nation', 'supplier')"), "supplier": g.notes.where("folder = 'supplier'")},
)
matched(
    "pattern_undirected", Pattern([Hop("file", "up", "near", undirected=True)]),
    f"{GRAPH}, u AS {_UP} SELECT DISTINCT * FROM (SELECT src AS file, dst AS near FROM u UNION ALL SELECT dst, src FROM u) WHERE file LIKE 'customer/%'",
    None, lambda g: {"file": g.notes.where("folder = 'customer'")},
)
TRIANGLE = Pattern([Hop("order", "has", "part"), Hop("part", "from", "supplier"), Hop("order", "by", "supplier")])
add(
    "pattern_triangles", lambda s, d: TRIANGLE.match(purchases(s, d)),
    """WITH has AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), made AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), sold AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem)
SELECT 'order/' || has.o || '.md' AS "order", 'part/' || has.p || '.md' AS part, 'supp/' || made.s || '.md' AS supplier FROM has JOIN made ON made.p = has.p JOIN sold ON sold.o = has.o AND sold.s = made.s""",
)

# ---- rules ----


def ruled(name: str, rules: Callable[[Graph], list[Rule]], sql: str, source: Callable[[SparkSession, str], Graph] = tables.hierarchy) -> None:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = source(spark, sf_dir)
        return with_rules(graph.edges, rules(graph)).where("implied_from is not null and ord = 0").select("src", "dst", "relation", "implied", "implied_from")

    add(name, call, sql)


def _explicit(spark: SparkSession, sf_dir: str) -> Graph:
    graph = tables.hierarchy(spark, sf_dir)
    return Graph(graph.notes, graph.edges.where("not implied"))


ruled(
    "rules_recursive",
    lambda g: [
        Rule("a_parent", Pattern([Hop("file", "up", "p")]), [Implies("file", "above", "p")]),
        Rule("b_further", Pattern([Hop("file", "up", "p"), Hop("p", "above", "top")]), [Implies("file", "above", "top")]),
    ],
    f"""{closure_sql('up', 'true')}, near AS (SELECT root, path, min(hops) AS hops FROM hops WHERE hops > 0 GROUP BY 1, 2)
SELECT root AS src, path AS dst, 'above' AS relation, true AS implied, CASE WHEN hops = 1 THEN 'a_parent' ELSE 'b_further' END AS implied_from FROM near""",
    _explicit,
)
# Both hops are of the rule's own relation, so each round doubles the reach.
ruled(
    "rules_doubling",
    lambda g: [
        Rule("next", Pattern([Hop("a", "next", "b")]), [Implies("a", "later", "b")]),
        Rule("over", Pattern([Hop("a", "later", "b"), Hop("b", "later", "c")]), [Implies("a", "later", "c")]),
    ],
    f"""{NUMBERED} SELECT a.path AS src, b.path AS dst, 'later' AS relation, true AS implied, CASE WHEN b.i = a.i + 1 THEN 'next' ELSE 'over' END AS implied_from
FROM numbered a JOIN numbered b ON b.user_id = a.user_id AND b.i > a.i""",
    lambda s, d: (lambda g: Graph(g.notes, g.edges.where("not implied")))(tables.sequences(s, d)),
)
ruled(
    "rules_several_implied",
    lambda g: [
        Rule("uncle", Pattern([Hop("file", "up", "parent"), Hop("parent", "same", "uncle")]), [Implies("file", "uncle", "uncle"), Implies("uncle", "nephew", "file")], {"file": g.notes.where("folder <> 'orders'")}),
        Rule("same", Pattern([Hop("parent", "up", "top"), Hop("other", "up", "top")], [("parent", "other")]), [Implies("parent", "same", "other", both=True)], {"top": g.notes.where("folder = 'region'")}),
        Rule("family", Pattern([Hop("file", "up", "parent"), Hop("parent", "up", "gp")]), [Implies("file", "grandparent", "gp"), Implies("file", "ancestor", "parent"), Implies("file", "ancestor", "gp")]),
        Rule("family_again", "family", [Implies("gp", "grandchild", "file")]),
    ],
    f"""{GRAPH}, u AS {_UP}, same AS (SELECT a.src AS a, b.src AS b FROM u a JOIN u b ON a.dst = b.dst AND a.src <> b.src AND a.dst LIKE 'region/%'),
uncle AS (SELECT u.src, same.b FROM u JOIN same ON same.a = u.dst WHERE u.src NOT LIKE 'orders/%'), far AS (SELECT a.src, a.dst AS p, b.dst AS gp FROM u a JOIN u b ON b.src = a.dst)
SELECT a AS src, b AS dst, 'same' AS relation, true AS implied, 'same' AS implied_from FROM same
UNION ALL SELECT src, b, 'uncle', true, 'uncle' FROM uncle UNION ALL SELECT b, src, 'nephew', true, 'uncle' FROM uncle
UNION ALL SELECT src, gp, 'grandparent', true, 'family' FROM far UNION ALL SELECT gp, src, 'grandchild', true, 'family_again' FROM far
UNION ALL SELECT DISTINCT src, p, 'ancestor', true, 'family' FROM far UNION ALL SELECT DISTINCT src, gp, 'ancestor', true, 'family' FROM far""",
    _explicit,
)

# ---- ancestors by the first edge ----


def _ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two relations lead to each note; which comes first changes with the note."""
    graph = tables.hierarchy(spark, sf_dir)
    odd = F.col("ord") % 2
    turns = F.array(*(F.struct(F.lit(r).alias("relation"), o.alias("ord")) for r, o in (("zed", F.col("ord") * 2 + odd), ("abe", F.col("ord") * 2 + 1 - odd))))
    both = graph.edges.where("relation = 'down'").select("src", "dst", F.explode(turns).alias("t"), "label", "implied", "implied_from")
    edges = both.select("src", "dst", "t.relation", "label", "implied", "implied_from", "t.ord")
    return E.ancestors(edges, graph.notes.where("folder = 'orders'").select("path")).select("root", "path", "depth", "via")


add("ancestors_first_edge", _ancestors, f"""{GRAPH}, {walk_sql('up', SO)}
SELECT root, path, depth::INTEGER AS depth, CASE WHEN key[len(key)] % 2 = 0 THEN 'zed' ELSE 'abe' END AS via FROM walk""")

# ---- display of every property ----


def _open_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties as VARIANT: each note has only the keys that it has values for."""
    graph = tables.hierarchy(spark, sf_dir)
    keys = ("title", "acctbal", "segment", "status", "price", "priority")
    notes = graph.notes.withColumn("properties", F.parse_json(F.to_json(F.struct(*keys)))).drop(*keys)
    query = Query("All", Rel("down"), all_properties=True, display=[("title", prop("title")), ("file.folder", file("folder"))])
    rows = query.run(Graph(notes, graph.edges), notes.where("folder = 'region'").select("path"))
    return rows.select("root", "path", F.array_join(F.transform("display", lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("")))), "|").alias("display"))


_NUMBER = "CASE WHEN c.{0} = floor(c.{0}) THEN c.{0}::BIGINT::VARCHAR ELSE c.{0}::VARCHAR END"
add("display_all_open", _open_display, f"""{GRAPH}, {walk_sql('down', SR)} SELECT root, w.path,
concat_ws('|', 'acctbal=' || {_NUMBER.format('acctbal')}, 'price=' || {_NUMBER.format('price')}, 'priority=' || c.priority, 'segment=' || c.segment, 'status=' || c.status,
  'title=' || coalesce(c.title, ''), 'file.folder=' || c.folder) AS display FROM walk w JOIN notes c ON c.path = w.path""")

# ---- chains of siblings ----


def _of_users(spark: SparkSession, sf_dir: str) -> Graph:
    """Users with their events below them; `next` leads to a user's following event, unless it is a signup."""
    graph = tables.sequences(spark, sf_dir)
    e = tables.read(spark, sf_dir, "events")
    user = tables.path("user", F.col("user_id"))
    event = tables.path("events", F.col("event_id"))
    none = F.lit(None).cast("string")
    has = e.select(user.alias("src"), event.alias("dst"), F.lit("has").alias("relation"), none.alias("label"), F.lit(False).alias("implied"), none.alias("implied_from"), F.col("event_id").alias("ord"))
    begins = e.where("event_type = 'signup'").select(event.alias("dst"))
    onward = graph.edges.where("relation = 'next'").join(begins, "dst", "left_anti").select(*has.columns)
    users = e.select(user.alias("path")).distinct()
    notes = graph.notes.unionByName(users.withColumn("folder", F.lit("user")), allowMissingColumns=True)
    return Graph(notes, has.unionByName(onward))


def chained(name: str, sort: list, sql: str) -> None:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = _of_users(spark, sf_dir)
        return Query("Chains", Rel("has"), sort=sort).run(graph, graph.notes.where("folder = 'user'").select("path")).select("root", "path", "sibling_rank")

    add(name, call, f"{NUMBERED} {sql}")


_RANKED = """, plain AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, event_id::VARCHAR) AS n FROM numbered),
parted AS (SELECT *, sum(CASE WHEN {starts} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS chain FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY i) AS was FROM plain)),
headed AS (SELECT *, first_value(n) OVER (PARTITION BY user_id, chain ORDER BY i) AS head FROM parted)
SELECT 'user/' || user_id || '.md' AS root, path, row_number() OVER (PARTITION BY user_id ORDER BY head, i) AS sibling_rank FROM headed"""
chained("sort_chain_first", [Chain(("next",)), (prop("value"), "desc")], _RANKED.format(order="value DESC NULLS FIRST", starts="was IS NULL OR event_type = 'signup'"))
chained(
    "sort_chain_within_equal", [prop("type"), Chain(("next",)), (prop("value"), "desc")],
    _RANKED.format(order="event_type, value DESC NULLS FIRST", starts="was IS DISTINCT FROM event_type OR event_type = 'signup'"),
)

# ---- groups of notes ----


def _as_roots(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("path").alias("root"), "path")


def _folder_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = tables.notes(spark, sf_dir)
    return G.folder_siblings(notes).step(_as_roots(notes.where("folder in ('region', 'nation', 'supplier')")))


add("group_folder_siblings", _folder_siblings, f"{GRAPH} SELECT a.path AS root, b.path FROM notes a JOIN notes b ON b.folder = a.folder AND b.path <> a.path WHERE a.folder IN ('region', 'nation', 'supplier')")


def _folder_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a folder for each region, suppliers in one for each nation below it."""
    n = tables.read(spark, sf_dir, "nation")
    s = tables.read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    region = F.concat_ws("/", F.lit("world"), "n_regionkey")
    nations = n.select(tables.path("nation", F.col("n_nationkey")).alias("path"), region.alias("folder"))
    suppliers = s.select(tables.path("supplier", F.col("s_suppkey")).alias("path"), F.concat_ws("/", region, "n_nationkey").alias("folder"))
    top = spark.range(1).select(F.lit("index.md").alias("path"), F.lit("world").alias("folder"))
    notes = nations.unionByName(suppliers).unionByName(top)
    return G.folder_children(notes).step(_as_roots(notes))


add("group_folder_children", _folder_children, """SELECT 'nation/' || n.n_nationkey || '.md' AS root, 'supplier/' || s.s_suppkey || '.md' AS path
FROM nation n JOIN nation m ON m.n_regionkey = n.n_regionkey JOIN supplier s ON s.s_nationkey = m.n_nationkey
UNION ALL SELECT 'index.md', 'nation/' || n_nationkey || '.md' FROM nation UNION ALL SELECT 'index.md', 'supplier/' || s_suppkey || '.md' FROM supplier""")


def _same_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = tables.notes(spark, sf_dir)
    return G.same_tag(notes, "#building").step(_as_roots(notes.where("acctbal > 8500")))


add("group_same_tag", _same_tag, f"{GRAPH} SELECT a.path AS root, b.path FROM notes a JOIN notes b ON list_contains(a.tags, '#building') AND list_contains(b.tags, '#building') AND b.path <> a.path WHERE a.acctbal > 8500")


def _same_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other customers of a segment and the other orders of a priority hold, without a row for any pair."""
    notes = tables.notes(spark, sf_dir)
    out = [G.same_property(some, key).others(some, value) for some, key, value in ((notes.where("folder = 'customer'"), "segment", "acctbal"), (notes.where("folder = 'orders'"), "priority", "price"))]
    return out[0].unionByName(out[1]).withColumn("sum", F.round("sum", 2))


_LEFT_OUT = """SELECT a.path, t.n - 1 AS count, round(t.s - coalesce(a.{v}, 0), 2) AS sum, CASE WHEN a.{v} = t.lo AND t.lo_n = 1 THEN t.lo2 ELSE t.lo END AS least, CASE WHEN a.{v} = t.hi AND t.hi_n = 1 THEN t.hi2 ELSE t.hi END AS greatest
FROM notes a JOIN (SELECT {g}, count(*) AS n, sum({v}) AS s, min({v}) AS lo, max({v}) AS hi, count(*) FILTER ({v} = m) AS lo_n, count(*) FILTER ({v} = x) AS hi_n, min({v}) FILTER ({v} > m) AS lo2, max({v}) FILTER ({v} < x) AS hi2
  FROM (SELECT *, min({v}) OVER (PARTITION BY {g}) AS m, max({v}) OVER (PARTITION BY {g}) AS x FROM notes WHERE folder = '{f}') GROUP BY {g}) t ON t.{g} = a.{g} WHERE a.folder = '{f}'"""
add("group_same_property_others", _same_property, f"{GRAPH} {_LEFT_OUT.format(g='segment', v='acctbal', f='customer')} UNION ALL {_LEFT_OUT.format(g='priority', v='price', f='orders')}")


def _same_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings of siblings: all orders of a customer, each once for a root, the root itself where it has a sibling."""
    graph = tables.hierarchy(spark, sf_dir, ("customer", "orders"))
    up = graph.edges.where("not implied and src like 'orders/%'")
    return G.same_target(up, "up").reach(graph.notes.where("folder = 'orders' and price > 300000").select("path"))


add("group_same_target_reach", _same_target, f"""{GRAPH}, u AS (SELECT src, dst FROM edges WHERE relation = 'up' AND src LIKE 'orders/%'), sizes AS (SELECT dst, count(*) AS n FROM u GROUP BY 1)
SELECT a.src AS root, b.src AS path, CASE WHEN a.src = b.src THEN 2 ELSE 1 END AS hops FROM u a JOIN notes r ON r.path = a.src AND r.price > 300000 JOIN u b ON b.dst = a.dst JOIN sizes s ON s.dst = a.dst AND s.n > 1""")
