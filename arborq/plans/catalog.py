"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.functions import scalar
from arborq.functions.expr import Expr, Row, duration, file, lit, prop, traversal
from arborq.operators import edges as E
from arborq.operators import implied, tree
from arborq.operators.traverse import Rel
from arborq.plans import query as Q
from arborq.plans.query import Graph, Query
from arborq.sources import inline, tables
from arborq.sources import notes as N
from arborq.sources.frontmatter import parse_front_matter

Call = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Call] = {}
SQL: dict[str, str] = {}

# ---- SQL of the graph ----

NOTES = """notes AS (
  SELECT 'region/' || r_regionkey || '.md' AS path, r_regionkey::VARCHAR AS name, 'region' AS folder, NULL::TIMESTAMP AS created, 100 + r_regionkey AS size,
    []::VARCHAR[] AS tags, []::VARCHAR[] AS links, r_name AS title, NULL::DOUBLE AS acctbal, NULL::VARCHAR AS segment, NULL::VARCHAR AS status, NULL::DOUBLE AS price, NULL::VARCHAR AS priority FROM region
  UNION ALL SELECT 'nation/' || n_nationkey || '.md', n_nationkey::VARCHAR, 'nation', NULL, 100 + n_nationkey, [], ['region/' || n_regionkey || '.md'], n_name, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'customer/' || c_custkey || '.md', c_custkey::VARCHAR, 'customer', NULL, 100 + c_custkey, ['#' || lower(c_mktsegment)], ['nation/' || c_nationkey || '.md'], c_name,
    CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END, c_mktsegment, NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey || '.md', s_suppkey::VARCHAR, 'supplier', NULL, 100 + s_suppkey, [], ['nation/' || s_nationkey || '.md'], s_name, s_acctbal, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'orders/' || o_orderkey || '.md', o_orderkey::VARCHAR, 'orders', o_orderdate, 100 + o_orderkey, [lower(o_orderstatus)], ['customer/' || o_custkey || '.md'],
    NULL, NULL, NULL, o_orderstatus, o_totalprice, o_orderpriority FROM orders
)"""
EDGES = """up AS (
  SELECT 'nation/' || n_nationkey || '.md' AS src, 'region/' || n_regionkey || '.md' AS dst, NULL::VARCHAR AS label, n_nationkey::BIGINT AS ord FROM nation
  UNION ALL SELECT 'customer/' || c_custkey || '.md', 'nation/' || c_nationkey || '.md', NULL, c_custkey * 2 FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey || '.md', 'nation/' || s_nationkey || '.md', NULL, s_suppkey * 2 + 1 FROM supplier
  UNION ALL SELECT 'orders/' || o_orderkey || '.md', 'customer/' || o_custkey || '.md', lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9_-]+', '_', 'g')), o_orderkey FROM orders
), edges AS (
  SELECT src, dst, 'up' AS relation, label, false AS implied, NULL::VARCHAR AS implied_from, ord FROM up
  UNION ALL SELECT dst, src, 'down', NULL, true, 'up', ord FROM up
)"""
GRAPH = f"WITH RECURSIVE {NOTES}, {EDGES}"
SHOWN = "root, path, relation, label, depth::INTEGER AS depth, implied, parent, array_to_string(route, '>') AS route, array_to_string(key, '.') AS place"


def walk_sql(rel: str, start: str, depth: int = 99, label: str | None = None, prune: str = "false", name: str = "walk", item: int = 0) -> str:
    """A recursive CTE of all paths along a relation; prune is a condition on the candidate note c."""
    kept = f"e.relation = '{rel}'" + (f" AND e.label = '{label}'" if label else "") + f" AND NOT coalesce({prune}, false)"
    return f"""{name} AS (
  SELECT s.path AS root, e.dst AS path, e.relation, e.label, 1 AS depth, e.implied, s.path AS parent, [s.path, e.dst] AS route, [{item}::BIGINT, e.ord] AS key
  FROM notes s JOIN edges e ON e.src = s.path JOIN notes c ON c.path = e.dst WHERE {start} AND {kept} AND {depth} > 0
  UNION ALL
  SELECT w.root, e.dst, e.relation, e.label, w.depth + 1, e.implied, w.path, list_append(w.route, e.dst), list_append(w.key, e.ord)
  FROM {name} w JOIN edges e ON e.src = w.path JOIN notes c ON c.path = e.dst WHERE {kept} AND NOT list_contains(w.route, e.dst) AND w.depth < {depth}
)"""


def shown(rows: DataFrame, *more) -> DataFrame:
    """A result's rows with arrays as texts."""
    return rows.select(
        "root", "path", "relation", "label", "depth", "implied", "parent", F.concat_ws(">", "traversal_path").alias("route"), F.concat_ws(".", "key").alias("place"), *more
    )


def add(name: str, call: Call, sql: str | None = None) -> None:
    QUERIES[name] = call
    if sql is not None:
        SQL[name] = sql


def roots(graph: Graph, condition: str) -> DataFrame:
    return graph.notes.where(condition).select("path")


def run(query: Query, start: str, show: Callable[[DataFrame], DataFrame] = shown, groups: dict | None = None, levels: tuple[str, ...] = tables.LEVELS) -> Call:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = tables.hierarchy(spark, sf_dir, levels)
        graph.groups.update(groups or {})
        return show(query.run(graph, roots(graph, start)))

    return call


# ---- walks ----

R, C, O = "folder = 'region'", "folder = 'customer'", "folder = 'orders'"
SR, SC, SO = ("s." + x for x in (R, C, O))


def walk(name: str, query: Query, start: str, sql_walk: str, where: str = "true") -> None:
    add(name, run(query, start), f"{GRAPH}, {sql_walk} SELECT {SHOWN} FROM walk WHERE {where}")


walk("traverse_down_tree", Query("Tree", Rel("down")), R, walk_sql("down", SR))
walk("traverse_up_tree", Query("Parents", Rel("up")), O, walk_sql("up", SO))
walk("traverse_depth_limit", Query("Two levels", Rel("down", depth=2)), R, walk_sql("down", SR, 2))
walk("traverse_label", Query("Urgent", Rel("up", label="1-urgent", depth=1)), O, walk_sql("up", SO, 1, "1-urgent"))
walk(
    "prune_subtree", Query("Pruned", Rel("down"), prune=(prop("acctbal") < 0) | prop("status").eq("P")), R,
    walk_sql("down", SR, prune="(coalesce(c.acctbal < 0, false) OR coalesce(c.status = 'P', false))"),
)
walk("prune_by_walk", Query("Shallow", Rel("down"), prune=traversal("depth") > 2), R, walk_sql("down", SR, 2))
add(
    "multi_relation_union", run(Query("Both", Rel("up", depth=1), Rel("down", depth=1)), C),
    f"{GRAPH}, {walk_sql('up', SC, 1)}, {walk_sql('down', SC, 1, name='second', item=1)} SELECT {SHOWN} FROM walk UNION ALL SELECT {SHOWN} FROM second",
)


def _near(spark: SparkSession, sf_dir: str) -> Graph:
    """Events of a user, each tied to the one before and the one after by `near`: every walk could turn back."""
    graph = tables.sequences(spark, sf_dir)
    tied = implied.with_implied(graph.edges.where("relation = 'next'"), [implied.Rule("next", "near", "both")])
    return Graph(graph.notes, implied.renumbered(tied.where("relation = 'near'")))


NUMBERED = "WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, 'events/' || event_id || '.md' AS path FROM events)"


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _near(spark, sf_dir)
    return Query("Cycle", Rel("near", depth=4)).run(graph, roots(graph, "type = 'signup'")).select("root", "path", "relation", "depth", "implied", "parent")


add("traverse_cycle_safe", _cycles, f"""{NUMBERED}
SELECT a.path AS root, b.path AS path, 'near' AS relation, abs(b.i - a.i)::INTEGER AS depth, true AS implied, p.path AS parent
FROM numbered a JOIN numbered b ON a.user_id = b.user_id AND a.event_type = 'signup' AND abs(b.i - a.i) BETWEEN 1 AND 4
JOIN numbered p ON p.user_id = b.user_id AND p.i = b.i - sign(b.i - a.i)""")


def _bfs_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _near(spark, sf_dir)
    rows = Query("Flat", Rel("near", flatten=True, depth=6)).run(graph, roots(graph, "type = 'signup'"))
    return rows.select("root", "path", "depth", "parent", F.size("traversal_path").alias("steps"))


add("flatten_bfs_cycles", _bfs_cycles, f"""{NUMBERED}
SELECT a.path AS root, b.path AS path, 1 AS depth, a.path AS parent, abs(b.i - a.i)::INTEGER + 1 AS steps
FROM numbered a JOIN numbered b ON a.user_id = b.user_id AND a.event_type = 'signup' AND abs(b.i - a.i) BETWEEN 1 AND 6""")
add(
    "flatten_bfs", run(Query("Flat", Rel("down", flatten=True)), R, lambda r: r.select("root", "path", "depth", "parent", F.concat_ws(">", "traversal_path").alias("route"))),
    f"{GRAPH}, {walk_sql('down', SR)} SELECT root, path, 1 AS depth, root AS parent, array_to_string(route, '>') AS route FROM walk",
)
add(
    "flatten_partial", run(Query("Partly flat", Rel("down", flatten=1)), R, lambda r: shown(r, F.concat_ws(".", "parent_key").alias("above"))),
    f"{GRAPH}, {walk_sql('down', SR)} SELECT {SHOWN}, CASE WHEN len(key) > 2 THEN array_to_string(key[1:2], '.') ELSE '' END AS above FROM walk",
)
add(
    "where_promote",
    run(Query("Rich", Rel("down"), where=(prop("acctbal") > 5000) | (prop("price") > 200000)), R, lambda r: shown(r, F.concat_ws(".", "parent_key").alias("above"), "has_filtered_ancestor")),
    f"""{GRAPH}, {walk_sql('down', SR)},
kept AS (SELECT w.* FROM walk w JOIN notes c ON c.path = w.path WHERE coalesce(c.acctbal > 5000, false) OR coalesce(c.price > 200000, false)),
climbed AS (SELECT root, key, len(key) - i AS n FROM (SELECT root, key, unnest(range(1, len(key) - 1)) AS i FROM kept WHERE len(key) > 2)),
nearest AS (SELECT c.root, c.key, max(c.n) AS n FROM climbed c JOIN kept k ON k.root = c.root AND k.key = c.key[1:c.n] WHERE c.n >= 2 GROUP BY 1, 2)
SELECT {SHOWN.replace('root, path', 'k.root, path').replace('(key', '(k.key')}, coalesce(array_to_string(k.key[1:n.n], '.'), '') AS above,
  len(k.key) > 2 AND coalesce(n.n, 0) <> len(k.key) - 1 AS has_filtered_ancestor
FROM kept k LEFT JOIN nearest n ON n.root = k.root AND n.key = k.key""",
)
_CHAINED = f"""{GRAPH}, {walk_sql('up', SC, 1)},
second AS (SELECT w.root, e.dst AS path, e.relation, e.label, 1 AS depth, e.implied, w.path AS parent, [w.path, e.dst] AS route, list_append(w.key, e.ord) AS key
  FROM walk w JOIN edges e ON e.src = w.path AND e.relation = 'up' AND NOT list_contains(w.route, e.dst))
SELECT {SHOWN} FROM walk UNION ALL SELECT {SHOWN} FROM second"""
add("chain_relation", run(Query("Then", Rel("up", depth=1) >> Rel("up", depth=1)), C), _CHAINED)
add("chain_group", run(Query("Then group", Rel("up", depth=1) >> "Above"), C, groups={"Above": Query("Above", Rel("up", depth=1), where=lit(False))}), _CHAINED)
add(
    "chain_inline",
    run(Query("Then inline", Rel("down", depth=1) >> Query("", Rel("down", depth=1), where=prop("acctbal") > 9000)), R),
    f"""{GRAPH}, {walk_sql('down', SR, 1)},
second AS (SELECT w.root, e.dst AS path, e.relation, e.label, 1 AS depth, e.implied, w.path AS parent, [w.path, e.dst] AS route, list_append(w.key, e.ord) AS key
  FROM walk w JOIN edges e ON e.src = w.path AND e.relation = 'down' JOIN notes c ON c.path = e.dst AND c.acctbal > 9000)
SELECT {SHOWN} FROM walk UNION ALL SELECT {SHOWN} FROM second""",
)
add(
    "ancestors_incoming",
    lambda s, d: (lambda g: E.ancestors(g.edges, roots(g, "folder = 'orders'"), ["down"]).select("root", "path", "depth", "via", "implied", "implied_from"))(tables.hierarchy(s, d)),
    f"""{GRAPH}, {walk_sql('up', SO)} SELECT root, path, depth::INTEGER AS depth, 'down' AS via, true AS implied, 'up' AS implied_from FROM walk""",
)


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = tables.sequences(spark, sf_dir)
    return Query("Next", Rel("next", depth=20)).run(graph, graph.notes.where("type = 'signup'").select("path")).select("root", "path", "label", "depth", "implied")


add("sequence_next", _sequence, """
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT 'events/' || a.event_id || '.md' AS root, 'events/' || b.event_id || '.md' AS path, b0.event_type AS label, (b.i - a.i)::INTEGER AS depth, false AS implied
FROM numbered a JOIN numbered b ON a.user_id = b.user_id AND b.i BETWEEN a.i + 1 AND a.i + 20 AND a.event_type = 'signup'
JOIN numbered b0 ON b0.user_id = b.user_id AND b0.i = b.i - 1""")

# ---- edges ----

RULED = "SELECT src, dst, relation, label, implied, implied_from"


def rules(name: str, rule: implied.Rule, sql: str, levels: tuple[str, ...] = tables.LEVELS) -> None:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return implied.with_implied(tables.up_edges(spark, sf_dir, levels), [rule]).drop("ord")

    explicit = "SELECT src, dst, 'up' AS relation, label, false AS implied, NULL::VARCHAR AS implied_from FROM few"
    kept = f"WHERE {' OR '.join(f'src LIKE {(x + chr(47) + chr(37))!r}' for x in levels)}"
    add(name, call, f"WITH {EDGES}, few AS (SELECT * FROM up {kept}) {explicit} UNION ALL {sql}")


rules("implied_forward", implied.Rule("up", "above", "forward"), "SELECT src, dst, 'above', NULL, true, 'up' FROM few")
rules("implied_reverse", implied.Rule("up", "down", "reverse"), "SELECT dst, src, 'down', NULL, true, 'up' FROM few")
rules("implied_both", implied.Rule("up", "near", "both"), "SELECT src, dst, 'near', NULL, true, 'up' FROM few UNION ALL SELECT dst, src, 'near', NULL, true, 'up' FROM few")
# Sibling rules fan out with the square of a note's edges: the relation is the one from orders to their customer.
rules(
    "implied_sibling_target", implied.Rule("up", "same", "sibling"),
    "SELECT DISTINCT a.src, b.src, 'same', NULL, true, 'up' FROM few a JOIN few b ON a.dst = b.dst AND a.src <> b.src", ("orders",),
)


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = implied.with_implied(tables.up_edges(spark, sf_dir, ("orders",)), tables.RULES).where("relation = 'down'").withColumn("implied", F.lit(False))
    return implied.with_implied(down, [implied.Rule("down", "same", "sibling")]).drop("ord")


add("implied_sibling_source", _by_source, f"""WITH {EDGES}, few AS (SELECT * FROM up WHERE src LIKE 'orders/%')
SELECT dst AS src, src AS dst, 'down' AS relation, NULL AS label, false AS implied, 'up' AS implied_from FROM few
UNION ALL SELECT a.src, b.src AS dst, 'same', NULL, true, 'down' FROM few a JOIN few b ON a.dst = b.dst AND a.src <> b.src""")


def _suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = tables.up_edges(spark, sf_dir)
    some = up.where(F.col("ord") % 3 == 0).select(
        F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("down").alias("relation"), F.lit("given").alias("label"), "implied", "implied_from", "ord"
    )
    return implied.with_implied(up.unionByName(some), [implied.Rule("up", "down", "reverse")]).where("relation = 'down'").drop("ord")


add("implied_suppression", _suppressed, f"""WITH {EDGES} SELECT dst AS src, src AS dst, 'down' AS relation, CASE WHEN ord % 3 = 0 THEN 'given' END AS label,
ord % 3 <> 0 AS implied, CASE WHEN ord % 3 <> 0 THEN 'up' END AS implied_from FROM up""")


def graph_query(name: str, call: Callable[[Graph], DataFrame], sql: str) -> None:
    add(name, lambda s, d: call(tables.hierarchy(s, d)), f"{GRAPH} {sql}")


graph_query("edges_out", lambda g: E.outgoing(g.edges, roots(g, "folder = 'customer' and segment = 'BUILDING'"), "up").drop("ord"),
            f"{RULED} FROM edges WHERE relation = 'up' AND src IN (SELECT path FROM notes WHERE folder = 'customer' AND segment = 'BUILDING')")
graph_query("edges_in", lambda g: E.incoming(g.edges, roots(g, "folder = 'customer' and segment = 'BUILDING'"), "up", "1-urgent").drop("ord"),
            f"{RULED} FROM edges WHERE relation = 'up' AND label = '1-urgent' AND dst IN (SELECT path FROM notes WHERE folder = 'customer' AND segment = 'BUILDING')")
graph_query("backlinks", lambda g: E.backlinks(g.notes).select("path", F.concat_ws("|", "backlinks").alias("backlinks")),
            "SELECT target AS path, string_agg(path, '|' ORDER BY path) AS backlinks FROM (SELECT DISTINCT path, unnest(links) AS target FROM notes) GROUP BY 1")
graph_query(
    "rename_note",
    lambda g: E.rename(g.edges, g.notes.where("folder = 'nation'").select(F.col("path").alias("old"), F.replace("path", F.lit("nation/"), F.lit("country/")).alias("new"))).drop("ord"),
    "SELECT replace(src, 'nation/', 'country/') AS src, replace(dst, 'nation/', 'country/') AS dst, relation, label, implied, implied_from FROM edges",
)
graph_query("delete_note", lambda g: E.delete(g.edges, roots(g, "acctbal < 0")).drop("ord"),
            f"{RULED} FROM edges WHERE src NOT IN (SELECT path FROM notes WHERE acctbal < 0) AND dst NOT IN (SELECT path FROM notes WHERE acctbal < 0)")
graph_query("relation_types", lambda g: E.relation_types(g.edges, ["next", "up"]), "SELECT * FROM (VALUES ('next', 0), ('up', 1)) t(relation, place) UNION ALL SELECT DISTINCT relation, 2 FROM edges WHERE relation NOT IN ('next', 'up')")
for _op, _value, _sql in (
    ("equals", "BUILDING", "coalesce(segment = 'BUILDING', false)"), ("contains", "MOB", "coalesce(contains(segment, 'MOB'), false)"), ("exists", None, "true"), ("notExists", None, "false"),
):
    graph_query(f"property_filter_{_op.lower()}", lambda g, op=_op, value=_value: g.notes.select("path", E.property_filter(g.notes, "Segment", op, value).alias("hit")),
                f"SELECT path, {_sql} AS hit FROM notes")
graph_query("edges_many_sources", lambda g: g.edges.groupBy("src", "relation").agg(F.count(F.lit(1)).alias("n")), "SELECT src, relation, count(*) AS n FROM edges GROUP BY 1, 2")

# ---- clauses ----

add("when_guard", run(Query("When", Rel("down", depth=1), when=prop("acctbal") > 9000), C), f"{GRAPH}, {walk_sql('down', SC + ' AND s.acctbal > 9000', 1)} SELECT {SHOWN} FROM walk")


def sorted_query(name: str, keys: list, order: str) -> None:
    query = Query("Sorted", Rel("down", depth=2), sort=keys)
    add(name, run(query, R, lambda r: r.select("root", "path", "sibling_rank")),
        f"""{GRAPH}, {walk_sql('down', SR, 2)} SELECT root, w.path, row_number() OVER (PARTITION BY root, len(key), CASE WHEN len(key) > 2 THEN key[2] END ORDER BY {order}, c.name, key) AS sibling_rank
FROM walk w JOIN notes c ON c.path = w.path""")  # fmt: skip


sorted_query("sort_asc_nulls_last", [prop("acctbal")], "c.acctbal ASC NULLS LAST")
sorted_query("sort_desc_nulls_first", [(prop("acctbal"), "desc")], "c.acctbal DESC NULLS FIRST")
sorted_query("sort_basename_tiebreak", [prop("segment")], "c.segment ASC NULLS LAST")
sorted_query("sort_two_keys", [(prop("segment"), "desc"), file("size")], "c.segment DESC NULLS FIRST, c.size ASC NULLS LAST")


def displayed(name: str, query: Query, pairs: list[tuple[str, str]]) -> None:
    texts = ", ".join(f"'{k}=' || coalesce({v}, '')" for k, v in pairs)
    show = lambda r: r.select("root", "path", F.array_join(F.transform("display", lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("")))), "|").alias("display"))
    add(name, run(query, R, show), f"{GRAPH}, {walk_sql('down', SR)} SELECT root, w.path, concat_ws('|', {texts}) AS display FROM walk w JOIN notes c ON c.path = w.path")


displayed("display_props", Query("Shown", Rel("down"), display=[("title", prop("title")), ("file.name", file("name")), ("file.size", file("size")), ("file.tags", file("tags"))]),
          [("title", "c.title"), ("file.name", "c.name"), ("file.size", "c.size::VARCHAR"), ("file.tags", "array_to_string(c.tags, ', ')")])
displayed(
    "display_all", Query("All", Rel("down"), all_properties=True, display=[("title", prop("title")), ("file.folder", file("folder"))], where=lit(True)),
    [(c, f"CASE WHEN c.{c} = floor(c.{c}) THEN c.{c}::BIGINT::VARCHAR ELSE c.{c}::VARCHAR END" if c in ("acctbal", "price") else f"c.{c}") for c in ("title", "acctbal", "segment", "status", "price", "priority")]
    + [("file.folder", "c.folder")],
)

# ---- aggregates ----


def aggregated(name: str, expr: Expr, sql: str, round_to: int | None = None) -> None:
    """The aggregate's value for every nation, over its customers, suppliers and orders."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = tables.hierarchy(spark, sf_dir)
        rows, row = graph.resolve(roots(graph, "folder in ('nation', 'customer')"), expr)
        value = expr.value(row).col
        return rows.select("path", (F.round(value, round_to) if round_to is not None else value).alias("value"))

    start = "s.folder IN ('nation', 'customer')"
    add(name, call, f"""{GRAPH}, {walk_sql('down', start)}, below AS (SELECT w.root, c.* FROM walk w JOIN notes c ON c.path = w.path)
SELECT n.path, {sql} AS value FROM notes n LEFT JOIN below b ON b.root = n.path WHERE n.folder IN ('nation', 'customer') GROUP BY n.path""")


DOWN = Rel("down")
aggregated("agg_count", Q.count(DOWN), "count(b.path)")
aggregated("agg_sum", Q.total(DOWN, prop("price")), "round(coalesce(sum(b.price), 0), 2)", 2)
aggregated("agg_avg", Q.average(DOWN, prop("price")), "round(avg(b.price), 4)", 4)
aggregated("agg_min", Q.least(DOWN, prop("price")), "min(b.price)")
aggregated("agg_max", Q.greatest(DOWN, prop("priority")), "max(b.priority)")
aggregated("agg_any", Q.any_of(DOWN, prop("price") > 250000), "coalesce(bool_or(coalesce(b.price > 250000, false)), false)")
aggregated("agg_all_vacuous", Q.all_of(DOWN, prop("status").eq("F")), "coalesce(bool_and(coalesce(b.status = 'F', false)) FILTER (WHERE b.path IS NOT NULL), true)")
aggregated("agg_file_property", Q.total(DOWN, file("size")), "coalesce(sum(b.size), 0)::BIGINT")
add(
    "inline_query_value",
    lambda s, d: (lambda g, e: (lambda rr: rr[0].select("path", F.concat_ws("|", e.value(rr[1]).col).alias("value")))(g.resolve(roots(g, "folder = 'customer'"), e)))(
        tables.hierarchy(s, d), Q.paths(Query("", Rel("down", depth=1), where=prop("price") > 100000))),
    f"""{GRAPH}, {walk_sql('down', SC, 1)}, below AS (SELECT w.root, w.key, w.path FROM walk w JOIN notes c ON c.path = w.path WHERE c.price > 100000)
SELECT n.path, coalesce(string_agg(b.path, '|' ORDER BY b.key), '') AS value FROM notes n LEFT JOIN below b ON b.root = n.path WHERE n.folder = 'customer' GROUP BY n.path""",
)
add(
    "agg_in_where", run(Query("Busy", Rel("down", depth=2), where=Q.count(Rel("down", depth=1)) > 12), R),
    f"""{GRAPH}, {walk_sql('down', SR, 2)}, n AS (SELECT src, count(*) AS n FROM edges WHERE relation = 'down' GROUP BY 1)
SELECT {SHOWN} FROM walk JOIN n ON n.src = path WHERE n.n > 12""",
)

# ---- expressions over every note ----

DAY = dt.datetime(1996, 1, 1)


def scalar_query(name: str, expr: Expr, sql: str) -> None:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        notes = tables.notes(spark, sf_dir)
        v = expr.value(Row.of(notes))
        return notes.select("path", (F.concat_ws("|", v.col) if v.kind == "arr" else v.col.cast("long") if v.kind == "num" else v.col).alias("value"))

    add(name, call, f"WITH {NOTES} SELECT path, {sql} AS value FROM notes")


ACCT, SEG, TITLE, STATUS = prop("acctbal"), prop("segment"), prop("title"), prop("status")
CREATED = file("created")
f = scalar.call
_T, _S = "coalesce(title, '')", "coalesce(segment, '')"
for _name, _expr, _sql in (
    ("cmp_null_safe", SEG.eq(None), "segment IS NULL"),
    ("cmp_not_equal", ACCT.ne(100), "acctbal IS DISTINCT FROM 100"),
    ("cmp_strict_kinds", ACCT.eq("100"), "false OR acctbal IS NULL AND '100' IS NULL"),
    ("cmp_eq_opt", SEG.eq_if_present("BUILDING"), "coalesce(segment = 'BUILDING', false)"),
    ("cmp_ne_opt", SEG.ne_if_present("BUILDING"), "coalesce(segment <> 'BUILDING', true)"),
    ("cmp_less", ACCT < 1000, "acctbal < 1000"),
    ("cmp_less_equal", file("size") <= 1000, "size <= 1000"),
    ("cmp_greater", prop("price") > 100000, "price > 100000"),
    ("cmp_greater_equal", CREATED >= DAY, "created >= TIMESTAMP '1996-01-01'"),
    ("cmp_text_order", TITLE < "M", "title < 'M'"),
    ("cmp_mixed_kinds", file("size") < "2", "size::VARCHAR < '2'"),
    ("logic_and", (ACCT > 0) & SEG, "coalesce(acctbal > 0, false) AND coalesce(segment <> '', false)"),
    ("logic_or", (ACCT > 5000) | prop("absent") | prop("price"), "coalesce(acctbal > 5000, false) OR coalesce(price <> 0, false)"),
    ("logic_not", ~SEG, "NOT coalesce(segment <> '', false)"),
    ("in_array", lit("#building").is_in(file("tags")), "list_contains(tags, '#building')"),
    ("in_string", lit("UILD").is_in(SEG), "coalesce(contains(segment, 'UILD'), false)"),
    ("in_null", lit("x").is_in(prop("absent")), "false"),
    ("in_range", ACCT.between(0, 5000), "acctbal BETWEEN 0 AND 5000"),
    ("arith_plus", file("size") + 7, "(size + 7)::BIGINT"),
    ("arith_minus", file("size") - 7, "(size - 7)::BIGINT"),
    ("arith_text", SEG + "-" + file("size"), "segment || '-' || size"),
    ("arith_mismatch", ACCT + TITLE, "NULL::BIGINT"),
    ("date_plus_duration", CREATED + duration(1, "m"), "created + INTERVAL 30 DAY"),
    ("date_minus_duration", CREATED - duration(2, "w"), "created - INTERVAL 14 DAY"),
    ("date_literal_math", CREATED > (lit(DAY) - duration(1, "y")), "created > TIMESTAMP '1996-01-01' - INTERVAL 365 DAY"),
    ("property_absent", prop("absent").eq(None), "true"),
    ("file_fields", file("folder") + "|" + file("name") + "|" + file("path"), "folder || '|' || name || '|' || path"),
    ("fn_contains", f("contains", TITLE, "#00000"), f"contains({_T}, '#00000')"),
    ("fn_starts_with", f("startsWith", TITLE, "Cust"), f"starts_with({_T}, 'Cust')"),
    ("fn_ends_with", f("endsWith", TITLE, "1"), f"ends_with({_T}, '1')"),
    ("fn_length", f("length", TITLE), f"length({_T})"),
    ("fn_lower", f("lower", SEG), f"lower({_S})"),
    ("fn_upper", f("upper", TITLE), f"upper({_T})"),
    ("fn_trim", f("trim", lit(" \t") + SEG + "\n "), "coalesce(segment, '')"),
    ("fn_split", f("split", file("path"), "/"), "replace(path, '/', '|')"),
    ("fn_matches", f("matches", TITLE, "^c.*[02468]$", "i"), f"regexp_matches({_T}, '(?i)^c.*[02468]$')"),
    ("fn_len", f("len", file("tags")), "len(tags)"),
    ("fn_first", f("first", file("tags")), "tags[1]"),
    ("fn_last", f("last", f("split", file("path"), "/")), "split_part(path, '/', 2)"),
    ("fn_is_empty", f("isEmpty", file("tags")), "len(tags) = 0"),
    ("fn_exists", f("exists", ACCT), "acctbal IS NOT NULL"),
    ("fn_coalesce", f("coalesce", SEG, STATUS, TITLE), "coalesce(segment, status, title)"),
    ("fn_ifnull", f("ifnull", SEG, "none"), "coalesce(segment, 'none')"),
    ("fn_now", f("now") > DAY, "true"),
    ("fn_date", f("date", f("format", CREATED, "YYYY-MM-DD")), "date_trunc('day', created)::TIMESTAMP"),
    ("fn_year", f("year", CREATED), "year(created)"),
    ("fn_month", f("month", CREATED), "month(created)"),
    ("fn_day", f("day", CREATED), "day(created)"),
    ("fn_weekday", f("weekday", CREATED), "dayofweek(created)"),
    ("fn_hours", f("hours", CREATED), "hour(created)"),
    ("fn_minutes", f("minutes", CREATED), "minute(created)"),
    ("fn_date_diff", f("dateDiff", CREATED, DAY, "weeks"), "floor((epoch_ms(created) - epoch_ms(TIMESTAMP '1996-01-01')) / 604800000.0)::BIGINT"),
    ("fn_format", f("format", CREATED, "DD.MM.YYYY HH:mm:ss"), "strftime(created, '%d.%m.%Y %H:%M:%S')"),
    ("fn_has_tag", f("hasTag", "Building"), "list_contains(tags, '#building')"),
    ("fn_in_folder", f("inFolder", "customer"), "folder = 'customer'"),
    ("fn_has_extension", f("hasExtension", ".MD"), "path LIKE '%.md'"),
    ("fn_has_link", f("hasLink", "Nation/1"), "len(list_filter(links, lambda x: contains(x, 'nation/1'))) > 0"),
    ("fn_tags", f("tags"), "array_to_string(tags, '|')"),
    ("fn_outlinks", f("outlinks"), "array_to_string(links, '|')"),
):
    scalar_query(_name, _expr, _sql)


def _backlinks_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = tables.notes(spark, sf_dir)
    both = notes.join(E.backlinks(notes), "path", "left")
    return both.select("path", F.concat_ws("|", f("backlinks").value(Row.of(both)).col).alias("value"))


add("fn_backlinks", _backlinks_fn, f"""WITH {NOTES},
b AS (SELECT target, string_agg(path, '|' ORDER BY path) AS v FROM (SELECT path, unnest(links) AS target FROM notes) GROUP BY 1)
SELECT path, coalesce(v, '') AS value FROM notes LEFT JOIN b ON b.target = path""")
f = scalar.call

# ---- trees as shown ----


def merged_tree(graph: Graph) -> DataFrame:
    """Each customer's orders, met by two relations, and what lies above it."""
    return tree.merge_by_path(Query("Merged", Rel("up"), Rel("down", depth=1), Rel("up", depth=1)).run(graph, roots(graph, "folder = 'customer'")))


_JOIN = lambda c: F.concat_ws(">", c)
_MERGED = f"""{GRAPH}, {walk_sql('up', SC)}, {walk_sql('down', SC, 1, name='second', item=1)}, merged AS (
  SELECT root, array_to_string(route[2:], '>') AS chain, path, relation AS relations, false AS implied FROM walk
  UNION ALL SELECT root, path, path, relation, true FROM second)"""
graph_query("merge_by_path", lambda g: merged_tree(g).select("root", _JOIN("chain").alias("chain"), "path", F.concat_ws(",", "relations").alias("relations"), "implied"), f"{_MERGED[len(GRAPH):]} SELECT * FROM merged")
graph_query(
    "cluster_groups",
    lambda g: tree.cluster(merged_tree(g)).groupBy("root", _JOIN("chain").alias("chain"), "members").agg(F.first("path").alias("path")),
    f"""{_MERGED[len(GRAPH):]}, counted AS (SELECT root, count(*) AS n FROM second GROUP BY 1)
SELECT m.root, m.chain, CASE WHEN m.implied THEN c.n ELSE 1 END::BIGINT AS members, m.path FROM merged m LEFT JOIN counted c ON c.root = m.root""",
)
graph_query(
    "invert_groups", lambda g: tree.invert(merged_tree(g)).select("root", _JOIN("tip").alias("tip"), "place", "path"),
    f"""{_MERGED[len(GRAPH):]}, tips AS (SELECT root, route[2:] AS tip FROM walk w WHERE depth = 2 UNION ALL SELECT root, [path] FROM second)
SELECT root, array_to_string(tip, '>') AS tip, i::INTEGER AS place, tip[len(tip) - i] AS path FROM (SELECT root, tip, unnest(range(0, len(tip))) AS i FROM tips)""",
)

_TIPS = f"""{_MERGED[len(GRAPH):]}, tips AS (SELECT root, route[2:] AS tip FROM walk w WHERE depth = 2 UNION ALL SELECT root, [path] FROM second)"""
graph_query(
    "shown_direction",
    lambda g: tree.as_shown(Query("Shown", Rel("down", depth=1), Rel("up")).run(g, roots(g, "folder = 'customer'")), {"up": "ascending"}).select("root", _JOIN("tip").alias("tip"), "place", "path"),
    f"""{_TIPS}, placed AS (SELECT root, tip, unnest(range(0, len(tip))) AS i FROM tips)
SELECT p.root, array_to_string(tip, '>') AS tip, (CASE WHEN s.root IS NULL THEN len(tip) - 1 - i ELSE i END)::INTEGER AS place, tip[i + 1] AS path
FROM placed p LEFT JOIN (SELECT DISTINCT root FROM second) s ON s.root = p.root""",
)
graph_query(
    "cluster_subgroups",
    lambda g: tree.subgroups(tree.cluster(merged_tree(g))).select("root", _JOIN("chain").alias("chain"), F.concat_ws(",", "relations").alias("relations"), "members"),
    f"""{_MERGED[len(GRAPH):]}, counted AS (SELECT root, count(*) AS n FROM second GROUP BY 1)
SELECT m.root, m.chain, m.relations, CASE WHEN m.implied THEN c.n ELSE 1 END::BIGINT AS members FROM merged m LEFT JOIN counted c ON c.root = m.root""",
)

# ---- note texts: links are made from rows, as no text of the tables holds any ----


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    text = F.concat(F.lit("Order of "), "o_orderpriority", F.lit("\nup::[[customer/"), F.col("o_custkey").cast("string"), F.lit("#Top|buyer]] and [[status/"), "o_orderstatus", F.lit("]]::holds"))
    return o.select(tables.path("orders", F.col("o_orderkey")).alias("path"), text.alias("content"))


def _inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = inline.parse_inline(_written(spark, sf_dir))
    return parsed.select("path", F.explode("relations").alias("r")).select("path", "r.source", "r.relation", "r.label", "r.target")


def _texts(spark: SparkSession, sf_dir: str, form: str, *columns: str) -> DataFrame:
    """A note (path, content) for each order, its text a form filled with expressions over the row."""
    o = tables.read(spark, sf_dir, "orders")
    return o.select(tables.path("orders", F.col("o_orderkey")).alias("path"), F.format_string(form, *map(F.expr, columns)).alias("content"))


def _parsed(form: str, *columns: str) -> Call:
    """The relations found in texts."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = inline.parse_inline(_texts(spark, sf_dir, form, *columns))
        return parsed.select("path", F.explode("relations").alias("r")).select("path", "r.source", "r.relation", "r.label", "r.target", "r.pos")

    return call


_OWN = "'orders/' || o_orderkey || '.md'"
add("inline_triple", _parsed("[[customer/%s|buyer]]::Has.Bought::[[orders/%s#Top]] and [[status/%s]]:: holds :: [[x]]", "o_custkey", "o_orderkey", "o_orderstatus"),
    f"""SELECT {_OWN} AS path, 'customer/' || o_custkey AS source, 'has' AS relation, 'bought' AS label, 'orders/' || o_orderkey AS target, 0::BIGINT AS pos FROM orders
UNION ALL SELECT {_OWN}, 'status/' || o_orderstatus, 'holds', NULL, 'x', 1 FROM orders""")
add("inline_fan_out", _parsed("up::[[customer/%s]], also ::[[status/%s]] and ::[[customer/%s]]", "o_custkey", "o_orderstatus", "o_custkey"),
    f"""SELECT {_OWN} AS path, NULL::VARCHAR AS source, 'up' AS relation, NULL::VARCHAR AS label, 'customer/' || o_custkey AS target, 0::BIGINT AS pos FROM orders
UNION ALL SELECT {_OWN}, NULL, 'up', NULL, 'status/' || o_orderstatus, 1 FROM orders""")
add("inline_chain", _parsed("next::[[orders/%s]] ::-::[[orders/%s]] ::-:: [[orders/%s]]", "o_orderkey + 1", "o_orderkey + 2", "o_orderkey + 3"),
    f"""SELECT {_OWN} AS path, NULL::VARCHAR AS source, 'next' AS relation, NULL::VARCHAR AS label, 'orders/' || (o_orderkey + 1) AS target, 0::BIGINT AS pos FROM orders
UNION ALL SELECT {_OWN}, 'orders/' || (o_orderkey + 1), 'next', NULL, 'orders/' || (o_orderkey + 2), 1 FROM orders
UNION ALL SELECT {_OWN}, 'orders/' || (o_orderkey + 2), 'next', NULL, 'orders/' || (o_orderkey + 3), 2 FROM orders""")
add("inline_dedupe", _parsed("up::[[customer/%s]] UP:: [[customer/%s|again]] up.x::[[customer/%s]]", "o_custkey", "o_custkey", "o_custkey"),
    f"""SELECT {_OWN} AS path, NULL::VARCHAR AS source, 'up' AS relation, NULL::VARCHAR AS label, 'customer/' || o_custkey AS target, 0::BIGINT AS pos FROM orders
UNION ALL SELECT {_OWN}, NULL, 'up', 'x', 'customer/' || o_custkey, 1 FROM orders""")


def _fronted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes whose front-matter has relations in block lists, nested maps and dotted keys, and properties."""
    form = """---
relations:
  Parent:
    - "[[customer/%s]]"
    - plain
  next:
    follows:
      soon: "[[orders/%s|n]]"
prev.older: '[[orders/%s]]'
Status: %s
price: %s
tags: [a, "b, c"] # two
---
Title, no links"""
    notes = _texts(spark, sf_dir, form, "o_custkey", "o_orderkey + 1", "o_orderkey - 1", "o_orderstatus", "cast(cast(o_totalprice as decimal(18, 2)) as string)")
    return notes.withColumn("front_matter", N.front_block(F.col("content")))


def _front_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_front_matter(_fronted(spark, sf_dir), N.DEFAULT_RELATIONS)
    return parsed.select("path", F.explode("front_relations").alias("r")).select("path", "r.relation", "r.label", "r.target")


add("frontmatter_relations", _front_relations, f"""SELECT {_OWN} AS path, 'up' AS relation, NULL::VARCHAR AS label, 'customer/' || o_custkey AS target FROM orders
UNION ALL SELECT {_OWN}, 'up', NULL, 'plain' FROM orders UNION ALL SELECT {_OWN}, 'next', 'follows.soon', 'orders/' || (o_orderkey + 1) FROM orders
UNION ALL SELECT {_OWN}, 'prev', 'older', 'orders/' || (o_orderkey - 1) FROM orders""")


def _front_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_front_matter(_fronted(spark, sf_dir), N.DEFAULT_RELATIONS)
    field = lambda k: F.get_json_object("properties_json", f"$.{k}").alias(k)
    return parsed.select("path", field("status"), field("price").cast("double").alias("price"), field("tags"), field("relations").isNull().alias("consumed"))


add("frontmatter_properties", _front_properties, f"""SELECT {_OWN} AS path, o_orderstatus AS status, o_totalprice::DECIMAL(18, 2)::DOUBLE AS price, '["a","b, c"]' AS tags, true AS consumed FROM orders""")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by full path, by path without its ending, by base name (the shortest, then first path wins) and to nowhere."""
    paths = tables.notes(spark, sf_dir).select("path")
    name = F.regexp_extract("path", r"(\d+)\.md$", 1)
    links = paths.select(F.explode(F.array(F.col("path"), F.regexp_replace("path", r"\.md$", ""), name, F.concat(F.lit("nowhere/"), name))).alias("link"))
    return N.resolved(links, paths)


add("link_resolution", _resolved, f"""WITH {NOTES} SELECT path AS link, path AS resolved FROM notes UNION ALL SELECT replace(path, '.md', ''), path FROM notes
UNION ALL SELECT name, first(path ORDER BY length(path), path) FROM notes GROUP BY name""")


def _note_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of whole notes: parsed, resolved, names by their keys, in text order."""
    fronted = _fronted(spark, sf_dir).withColumn("content", F.concat("content", F.lit("\nchild::[[orders/"), F.regexp_extract("path", r"(\d+)", 1), F.lit("]] nothing::[[customer/1]]")))
    others = tables.notes(spark, sf_dir, ("customer",)).select("path", F.lit("").alias("content"), F.lit(None).cast("string").alias("front_matter"))
    return N.edges_of(fronted.unionByName(others)).drop("implied", "implied_from")


add("note_edges", _note_edges, f"""WITH o AS (SELECT *, {_OWN} AS path FROM orders)
SELECT path AS src, path AS dst, 'down' AS relation, NULL::VARCHAR AS label, 1::BIGINT AS ord FROM o
UNION ALL SELECT path, 'customer/' || o_custkey || '.md', 'up', NULL, 2 FROM o
UNION ALL SELECT o.path, b.path, 'next', 'follows.soon', 3 FROM o JOIN o b ON b.o_orderkey = o.o_orderkey + 1
UNION ALL SELECT o.path, b.path, 'prev', 'older', CASE WHEN EXISTS (SELECT 1 FROM o c WHERE c.o_orderkey = o.o_orderkey + 1) THEN 4 ELSE 3 END FROM o JOIN o b ON b.o_orderkey = o.o_orderkey - 1""")
add("inline_scanner", _inline, """SELECT 'orders/' || o_orderkey || '.md' AS path, NULL AS source, 'up' AS relation, NULL::VARCHAR AS label, 'customer/' || o_custkey AS target FROM orders
UNION ALL SELECT 'orders/' || o_orderkey || '.md', 'status/' || o_orderstatus, 'holds', NULL, NULL FROM orders""")
add("inline_prefix", lambda s, d: inline.prefix_only(_written(s, d)), "SELECT 'orders/' || o_orderkey || '.md' AS path, 'up' AS relation, 'customer/' || o_custkey AS target FROM orders")
add(
    "link_normalise",
    lambda s, d: tables.read(s, d, "customer").select("c_custkey", inline.normalised(F.concat(F.lit(" "), "c_name", F.lit("#part|alias"))).alias("link")),
    "SELECT c_custkey, split_part(c_name, '#', 1) AS link FROM customer",
)
add(
    "page_links",
    lambda s, d: tables.read(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("target")),
    "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS target FROM pages",
)
add(
    "conversation_next",
    lambda s, d: tables.read(s, d, "conversations").selectExpr("conv_id", "turn", "lead(turn) over (partition by conv_id order by turn) as next_turn").where("next_turn is not null"),
    "SELECT * FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations) WHERE next_turn IS NOT NULL",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers above a balance below each region, richest first."""
    query = Query("Children", Rel("down", depth=2), where=prop("acctbal") > 5000, sort=[(prop("acctbal"), "desc")], display=[("name", prop("title")), ("acctbal", prop("acctbal"))])
    return run(query, R, lambda r: shown(r, "sibling_rank", F.to_json("display").alias("display")))(spark, sf_dir)


_BALANCE = "CASE WHEN c.acctbal = floor(c.acctbal) THEN c.acctbal::BIGINT::VARCHAR ELSE c.acctbal::VARCHAR END"
add(
    "flagship", flagship,
    f"""{GRAPH}, {walk_sql('down', SR, 2)} SELECT {SHOWN.replace('path,', 'w.path,', 1)}, row_number() OVER (PARTITION BY root ORDER BY c.acctbal DESC, c.name, key) AS sibling_rank,
'[{{"key":"name","value":"' || c.title || '"}},{{"key":"acctbal","value":"' || {_BALANCE} || '"}}]' AS display FROM walk w JOIN notes c ON c.path = w.path WHERE c.acctbal > 5000""",
)
