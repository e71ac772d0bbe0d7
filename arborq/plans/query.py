"""Queries over a graph of notes, built from Python and run for many start notes at once.

    Query("Children", Rel("down", depth=2), where=prop("acctbal") > 0, sort=[(prop("acctbal"), "desc")]).run(graph, roots)

Sub-queries in expressions are not run per row: the distinct notes they start from are walked together, the
values grouped by start, and joined back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborq.functions import values as V
from arborq.functions.expr import Expr, Row, lit, prop
from arborq.functions.values import Value
from arborq.operators import traverse, tree
from arborq.operators.traverse import Pruner, Rel


@dataclass
class Graph:
    """notes: path, name, folder, created, modified, size, tags, links, backlinks and properties as columns; edges with ord; stored queries."""

    notes: DataFrame
    edges: DataFrame
    groups: dict[str, Query] = field(default_factory=dict)

    def relations(self) -> set[str]:
        return {r["relation"] for r in self.edges.select("relation").distinct().collect()}

    def resolve(self, rows: DataFrame, *exprs: Expr) -> tuple[DataFrame, Row]:
        """Rows with what the expressions need: the note's columns, and the aggregates by row."""
        fields = {f.name: f.dataType for f in rows.schema.fields}
        row = Row({}, fields)
        if any("file" in e.uses for e in exprs):
            names = [c for c in self.notes.columns]
            notes = self.notes.select(F.col("path").alias("_note_path"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_note"))
            rows = rows.join(notes, F.col("path") == F.col("_note_path"), "left").drop("_note_path")
            row = Row({f.name: f.dataType for f in self.notes.schema.fields}, fields, "_note")
        done: dict[int, Value] = {}
        for agg in {id(a): a for e in exprs for a in e.aggregates}.values():
            values, kind, default = agg.table(self, rows.select("path").distinct())
            name = f"_agg{len(done)}"
            rows = rows.join(values.select(F.col("start").alias(f"{name}_start"), F.col("value").alias(name)), F.col("path") == F.col(f"{name}_start"), "left").drop(f"{name}_start")
            filled = F.col(name)
            if default is not None:
                filled = F.coalesce(filled, F.array().cast("array<string>") if default == () else F.lit(default))
            done[id(agg)] = Value(kind, filled)
        return rows, replace(row, aggregates=done)


@dataclass(frozen=True)
class Chain:
    """A sort key that keeps siblings tied by these relations together, in their sequence, each chain at the place of its head.

    Before the other keys it goes over all siblings, after some of them only over those that these leave equal.
    """

    relations: tuple[str, ...] = ("next",)


@dataclass(frozen=True, eq=False)
class Query:
    """name, the relations to walk side by side, and the clauses. `all_properties` shows every property before `display`."""

    name: str
    items: tuple[Rel, ...]
    prune: Expr | None = None
    where: Expr | None = None
    when: Expr | None = None
    sort: tuple[tuple[Expr, str], ...] = ()
    display: tuple[tuple[str, Expr], ...] = ()
    all_properties: bool = False

    def __init__(self, name: str, *items: Rel, prune=None, where=None, when=None, sort=(), display=(), all_properties=False):
        if not items:
            raise ValueError("a query walks one relation at least")
        for key, value in (
            ("name", name), ("items", items), ("prune", prune), ("where", where), ("when", when), ("all_properties", all_properties),
            ("sort", tuple((s, "asc") if isinstance(s, Expr) else s for s in sort)), ("display", tuple(display)),
        ):
            object.__setattr__(self, key, value)

    def problems(self, graph: Graph) -> list[str]:
        """Names that the graph doesn't know. They don't stop a query: an unknown relation or group yields nothing."""
        known, found = graph.relations(), []
        for rel in self.items:
            for part in (rel, *rel.then):
                if isinstance(part, Rel) and part.relation not in known:
                    found.append(f"UNKNOWN_RELATION {part.relation}")
                if isinstance(part, str) and part not in graph.groups:
                    found.append(f"UNKNOWN_GROUP {part}")
        return found

    def visible(self, graph: Graph, roots: DataFrame) -> DataFrame:
        """Roots (column path) for which the `when` clause holds."""
        if self.when is None:
            return roots.select("path").distinct()
        rows, row = graph.resolve(roots.select("path").distinct(), self.when)
        return rows.where(self.when.truth(Row(row.notes, {"path": row.fields["path"]}, row.inside, row.aggregates))).select("path")

    def run(self, graph: Graph, roots: DataFrame) -> DataFrame:
        """Result rows for all roots (column path): the walk's columns, has_filtered_ancestor, and sibling_rank and display if asked for."""
        rows = walk(graph, self.visible(graph, roots), self.items, self.prune)
        return self._finished(graph, rows)

    def _finished(self, graph: Graph, rows: DataFrame) -> DataFrame:
        if self.where is not None:
            wide, row = graph.resolve(rows, self.where)
            rows = tree.promote(wide.withColumn("_ok", self.where.truth(row)).select(*rows.columns, "_ok"), "_ok")
        else:
            rows = rows.withColumn("has_filtered_ancestor", F.lit(False))
        if self.sort:
            columns = rows.columns
            keys = [k for k in self.sort if not isinstance(k, Chain)]
            wide, row = graph.resolve(rows, *(e for e, _ in keys))
            rows = tree.sort_siblings(wide, row, keys)
            for chain in (k for k in self.sort if isinstance(k, Chain)):
                before = [k for k in self.sort[: self.sort.index(chain)] if not isinstance(k, Chain)]
                links = graph.edges.where(F.col("relation").isin(list(chain.relations)))
                rows = tree.chained(rows, links, [V.sort_key(e.value(row)) for e, _ in before])
            rows = rows.select(*columns, "sibling_rank")
        shown = list(self.display)
        open_ = self.all_properties and "properties" in graph.notes.columns and isinstance(graph.notes.schema["properties"].dataType, T.VariantType)
        if self.all_properties:
            taken = {"path", "name", "folder", "created", "modified", "size", "tags", "links", "backlinks", "content"}
            own = [(c, prop(c)) for c in graph.notes.columns if c not in taken]
            own = [(c, e) for c, e in own if c != "properties" or not open_]
            shown = own + [(k, e) for k, e in shown if k not in {c for c, _ in own}]
        if shown or open_:
            columns = rows.columns
            wide, row = graph.resolve(rows, *(e for _, e in shown), *([prop("properties")] if open_ else []))
            rows = tree.display(wide, row, shown, row.raw("properties") if open_ else None).select(*columns, "display")
        return rows


def walk(graph: Graph, starts: DataFrame, items: tuple[Rel, ...], prune: Expr | None = None) -> DataFrame:
    """The walks of all items from all starts (column path), one below the other."""
    pruner = Pruner(prune, graph.notes, graph.resolve) if prune is not None else None
    out = None
    for i, rel in enumerate(items):
        rows = traverse.topped(_item(graph, traverse.seeds(starts, i), rel, pruner))
        out = rows if out is None else out.unionByName(rows)
    return out


def _item(graph: Graph, start: DataFrame, rel: Rel, prune: Pruner | None) -> DataFrame:
    flat = rel.flatten is True
    if flat:
        rows = traverse.breadth_first(start, graph.edges, rel, prune)
        tips = rows.where("leaf").select("root", "key", "path", F.col("traversal_path").alias("anc"), F.col("parent_key").alias("up"))
        rows = rows.drop("leaf")
    else:
        rows = traverse.depth_first(start, graph.edges, rel, prune)
        tips = traverse.leaves(rows).select("root", "key", "path", "anc", F.col("key").alias("up"))
        rows = rows.drop("anc")
    if rel.then:
        for more in _continued(graph, tips, rel.then, prune, flat):
            rows = rows.unionByName(more)
    if rel.flatten is not None and rel.flatten is not True and rel.flatten is not False:
        rows = traverse.partly_flat(rows, int(rel.flatten))
    return rows


def _continued(graph: Graph, tips: DataFrame, targets: tuple, prune: Pruner | None, flat: bool) -> list[DataFrame]:
    """Rows of the walks that go on at the tips: below them, or beside them where the walk was flat."""
    target, rest = targets[0], targets[1:]
    if isinstance(target, Query):  # inline: its own clauses; ancestors and later targets are not handed on
        starts = tips.select(F.col("path")).distinct()
        found = target.run(graph, starts).select(*traverse.ROW)
        at = tips.select(F.col("root").alias("_r"), F.col("key").alias("_k"), F.col("path").alias("_p"), F.col("up").alias("_up"))
        grafted = found.join(at, F.col("root") == F.col("_p"))
        step = lambda k: F.concat("_k", F.slice(k, 2, F.greatest(F.size(k) - 1, F.lit(0))))
        return [
            grafted.select(
                F.col("_r").alias("root"), step("key").alias("key"), F.when(F.col("parent_key").isNull(), F.col("_up")).otherwise(step("parent_key")).alias("parent_key"),
                *(c for c in traverse.ROW if c not in ("root", "key", "parent_key")),
            )
        ]
    if isinstance(target, str):
        if target not in graph.groups:
            return []
        specs = [Rel(i.relation, None, i.depth, i.flatten, rest) for i in graph.groups[target].items]
    else:
        specs = [replace(target, label=None, then=rest)]
    out = []
    for n, spec in enumerate(specs):
        start = tips.select("root", "key", "path", "anc", F.lit(n << 40).cast("long").alias("shift"))
        rows = _item(graph, start, spec, prune)
        if flat:
            ups = tips.select(F.col("root").alias("_r"), F.col("key").alias("_k"), F.col("up").alias("_up"), F.lit(True).alias("_hit"))
            rows = rows.join(ups, (F.col("root") == F.col("_r")) & (F.col("parent_key") == F.col("_k")), "left")
            rows = rows.withColumn("parent_key", F.when(F.col("_hit"), F.col("_up")).otherwise(F.col("parent_key"))).select(*traverse.ROW)
        out.append(rows.select(*traverse.ROW))
    return out


@dataclass(frozen=True, eq=False)
class SubQuery:
    """An aggregate over the walk from each row's note. make(value) gives (aggregated column, kind); default fills in for no rows."""

    source: object
    argument: Expr | None
    make: Callable[[Value | None], tuple[Column, str]]
    default: object

    def table(self, graph: Graph, starts: DataFrame) -> tuple[DataFrame, str, object]:
        rows = _rows_of(graph, starts, self.source)
        value = None
        if self.argument is not None:
            rows, row = graph.resolve(rows, self.argument)
            value = self.argument.value(row)
        column, kind = self.make(value)
        return rows.groupBy(F.col("root").alias("start")).agg(column.alias("value")), kind, self.default


def _rows_of(graph: Graph, starts: DataFrame, source: object) -> DataFrame:
    """Rows of a Query (all its clauses), a Rel, or a name: a stored query's relations without its clauses, else a relation."""
    if isinstance(source, Query):
        return source.run(graph, starts)
    if isinstance(source, str):
        items = tuple(Rel(i.relation, None, i.depth, i.flatten) for i in graph.groups[source].items) if source in graph.groups else (Rel(source),)
    else:
        items = (replace(source, label=None),)
    return walk(graph, starts, items)


def _aggregate(source: object, argument: Expr | None, make, default: object) -> Expr:
    agg = SubQuery(source, argument, make, default)
    return Expr(lambda r: r.aggregates[id(agg)], frozenset(), (agg,))


def count(source: object) -> Expr:
    """Nodes of the walk; a note on several branches counts each time."""
    return _aggregate(source, None, lambda v: (F.count(F.lit(1)), "num"), 0)


def _numbers(v: Value) -> Column:
    return v.col if v.kind == "num" else F.lit(None).cast("double")


def total(source: object, argument: Expr) -> Expr:
    """Sum of the numbers; 0 if there are none."""
    return _aggregate(source, argument, lambda v: (F.coalesce(F.sum(_numbers(v)), F.lit(0)), "num"), 0)


def average(source: object, argument: Expr) -> Expr:
    return _aggregate(source, argument, lambda v: (F.avg(_numbers(v)), "num"), None)


def least(source: object, argument: Expr) -> Expr:
    return _aggregate(source, argument, lambda v: (F.min_by(v.col, V.sort_key(v)) if v.kind == "str" else F.min(v.col), v.kind), None)


def greatest(source: object, argument: Expr) -> Expr:
    return _aggregate(source, argument, lambda v: (F.max_by(v.col, V.sort_key(v)) if v.kind == "str" else F.max(v.col), v.kind), None)


def any_of(source: object, condition: Expr) -> Expr:
    return _aggregate(source, condition, lambda v: (F.bool_or(V.truth(v)), "bool"), False)


def all_of(source: object, condition: Expr) -> Expr:
    """True where the walk is empty."""
    return _aggregate(source, condition, lambda v: (F.bool_and(V.truth(v)), "bool"), True)


def paths(source: object) -> Expr:
    """The walk's paths as an array in the order of the walk; empty, not null, where there are none."""
    make = lambda v: (F.transform(F.array_sort(F.collect_list(F.struct("key", "path"))), lambda x: x["path"]), "arr")
    return _aggregate(source, None, make, ())


def run_all(graph: Graph, queries: list[Query], roots: DataFrame) -> dict[str, DataFrame]:
    """Every query's result over one shared edge table."""
    return {q.name: q.run(graph, roots) for q in queries}


__all__ = ["Chain", "Graph", "Query", "all_of", "any_of", "average", "count", "greatest", "least", "lit", "paths", "run_all", "total", "walk"]
