"""Walks over an edge table for many start notes at once.

A result row has the columns root, key, parent_key, path, relation, label, depth, implied, implied_from, parent and
traversal_path. key is the row's place: the number of the `from` item, then one ord for each step, so that its order
is the order of the walk. parent_key is the key of the row above; null at the top.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborq.functions.expr import Expr, Row
from arborq.operators.common import checkpointed

ROW = ["root", "key", "parent_key", "path", "relation", "label", "depth", "implied", "implied_from", "parent", "traversal_path"]
UNROLLED, FOLDED = 3, 32  # levels in one plan; levels kept apart before they become one table


@dataclass(frozen=True)
class Rel:
    """One relation to walk: depth None is without limit; flatten True is breadth-first and flat, N keeps N levels."""

    relation: str
    label: str | None = None
    depth: int | None = None
    flatten: bool | int | None = None
    then: tuple[object, ...] = ()

    def __rshift__(self, other: object) -> Rel:
        """Go on at the leaves with another relation, the relations of a stored query, or an inline query."""
        if isinstance(other, Rel):
            return replace(self, then=(*self.then, replace(other, then=()), *other.then))
        return replace(self, then=(*self.then, other))


@dataclass(frozen=True)
class Pruner:
    """Candidates for which the expression is true are not walked, nor what lies below them."""

    expr: Expr
    notes: DataFrame | None
    resolve: Callable[[DataFrame, Expr], tuple[DataFrame, Row]]

    @property
    def fixed(self) -> bool:
        """Does it depend on the note alone, so that edges can be dropped before the walk?"""
        return "traversal" not in self.expr.uses

    def edges(self, edges: DataFrame) -> DataFrame:
        paths = edges.select(F.col("dst").alias("path")).distinct()
        rows, row = self.resolve(paths, self.expr)
        bad = rows.where(self.expr.truth(row)).select(F.col("path").alias("dst"))
        return edges.join(bad, "dst", "left_anti")

    def rows(self, rows: DataFrame) -> DataFrame:
        wide, row = self.resolve(rows, self.expr)
        return wide.where(~self.expr.truth(row)).select(*rows.columns)


def seeds(roots: DataFrame, item: int) -> DataFrame:
    """Start notes (column path) as the state before the first step."""
    return roots.select(
        F.col("path").alias("root"), F.array(F.lit(item).cast("long")).alias("key"), F.col("path"), F.array("path").alias("anc"),
        F.lit(0).cast("long").alias("shift"),
    )


def relevant(edges: DataFrame, rel: Rel) -> DataFrame:
    kept = edges.where(F.col("relation") == rel.relation)
    return kept.where(F.col("label") == rel.label) if rel.label is not None else kept


def depth_first(start: DataFrame, edges: DataFrame, rel: Rel, prune: Pruner | None = None) -> DataFrame:
    """Every path from the starts that meets no note twice. `start` has root, key, path, anc (notes not to be met again)
    and shift (added to the ord of first steps, so that several items may start at one place).

    Levels are joins; up to UNROLLED levels are one plan. A deeper walk is checkpointed after as many levels each time, one without a
    depth after each level, so that it tries none in vain beyond the first empty one, with which either ends. The number of paths is the size of the result.
    """
    e = relevant(edges, rel)
    if prune is not None and prune.fixed:
        e = prune.edges(e)
    e = e.select("src", F.col("dst"), "relation", "label", "implied", "implied_from", "ord")
    if rel.depth is None or rel.depth > UNROLLED:
        e = checkpointed(e)
    deep = rel.depth is None or rel.depth > UNROLLED
    frontier = start.select("root", "key", "path", "anc", F.array("path").alias("traversal_path"), F.lit(0).alias("depth"), "shift")
    levels: list[DataFrame] = []
    done = 0
    while rel.depth is None or done < rel.depth:
        laps = 1 if rel.depth is None else min(UNROLLED, rel.depth - done)
        some = []
        for lap in range(1, laps + 1):
            rows = _below(frontier, e)
            if prune is not None and not prune.fixed:
                rows = prune.rows(rows)
            some.append(rows.withColumn("_lap", F.lit(lap)))
            frontier = rows.select("root", "key", "path", "anc", "traversal_path", "depth", F.lit(0).cast("long").alias("shift"))
        done += laps
        rows = union(some)
        if deep:
            rows = checkpointed(rows)
            if rows.isEmpty():
                break
            last = rows.where(F.col("_lap") == laps)
            frontier = last.select("root", "key", "path", "anc", "traversal_path", "depth", F.lit(0).cast("long").alias("shift"))
        levels.append(rows.drop("_lap"))
        if len(levels) > FOLDED:
            levels = [checkpointed(union(levels))]
    if not levels:
        return _none(start)
    return union(levels)


def _below(frontier: DataFrame, e: DataFrame) -> DataFrame:
    """The rows one level below the frontier's."""
    step = frontier.join(e, F.col("path") == F.col("src")).where(~F.array_contains("anc", F.col("dst")))
    return step.select(
        "root", F.concat("key", F.array(F.col("ord") + F.col("shift"))).alias("key"), F.col("key").alias("parent_key"), F.col("dst").alias("path"), "relation", "label",
        (F.col("depth") + 1).alias("depth"), "implied", "implied_from", F.col("src").alias("parent"),
        F.concat("traversal_path", F.array("dst")).alias("traversal_path"), F.concat("anc", F.array("dst")).alias("anc"),
    )


def union(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def _none(start: DataFrame) -> DataFrame:
    text, flag = F.lit(None).cast("string"), F.lit(False)
    return start.where("false").select(
        "root", "key", F.col("key").alias("parent_key"), "path", text.alias("relation"), text.alias("label"), F.lit(0).alias("depth"), flag.alias("implied"),
        text.alias("implied_from"), text.alias("parent"), F.array("path").alias("traversal_path"), "anc",
    )


def breadth_first(start: DataFrame, edges: DataFrame, rel: Rel, prune: Pruner | None = None) -> DataFrame:
    """Each note reached once for a start, at its first discovery; all rows are at the top with depth 1.

    Of a level's paths to a note the least key wins, which is the order of a queue; this is a min over groups,
    combined before the shuffle. Pruned notes stay visited. Adds `leaf`: no new note was found from the row.
    """
    e = checkpointed(relevant(edges, rel).select("src", "dst", "relation", "label", "implied", "implied_from", "ord"))
    base = start.select("root", F.col("key").alias("base"), F.col("path").alias("from"))
    frontier = start.select("root", F.col("key").alias("base"), F.array().cast("array<bigint>").alias("walk"), "path", F.array("path").alias("traversal_path"), "shift")
    seen = frontier.select("root", "base", "path")
    levels, parents = [], []
    for level in count(1) if rel.depth is None else range(1, max(1, rel.depth) + 1):
        met = frontier.join(e, F.col("path") == F.col("src")).select(
            "root", "base", F.col("dst").alias("path"),
            F.struct(
                F.concat("walk", F.array(F.col("ord") + F.col("shift"))).alias("walk"), F.col("src").alias("parent"), "relation", "label", "implied", "implied_from",
                F.concat("traversal_path", F.array("dst")).alias("traversal_path"),
            ).alias("s"),
        )
        new = met.groupBy("root", "base", "path").agg(F.min("s").alias("s")).join(seen, ["root", "base", "path"], "left_anti")
        new = checkpointed(new.select("root", "base", "path", "s.*"))
        if new.isEmpty():
            break
        parents.append(new.select("root", "base", F.col("parent").alias("path")).distinct())
        seen = seen.unionByName(new.select("root", "base", "path"))
        if level % FOLDED == 0:
            seen, levels, parents = checkpointed(seen), [checkpointed(union(levels))] if levels else [], [checkpointed(union(parents))]
        if prune is not None:
            shown = new.join(base, ["root", "base"]).withColumn("depth", F.lit(1))
            new = checkpointed(prune.rows(shown).drop("from", "depth"))
        levels.append(new.withColumn("level", F.lit(level).cast("long")))
        frontier = new.select("root", "base", "walk", "path", "traversal_path", F.lit(0).cast("long").alias("shift"))
    if not levels:
        return _none(start).withColumn("leaf", F.lit(True)).drop("anc")
    busy = union(parents)
    out = union(levels).join(busy.withColumn("busy", F.lit(True)), ["root", "base", "path"], "left").join(base, ["root", "base"])
    return out.select(
        "root", F.concat("base", F.array("level"), "walk").alias("key"), F.when(F.size("base") > 1, F.col("base")).alias("parent_key"), "path", "relation", "label",
        F.lit(1).alias("depth"), "implied", "implied_from", F.col("from").alias("parent"), "traversal_path", F.col("busy").isNull().alias("leaf"),
    )


def partly_flat(rows: DataFrame, keep: int, base: int = 1) -> DataFrame:
    """Rows deeper than `keep` levels hang, in the order of the walk, on their ancestor at that level."""
    n = max(1, keep) + base
    return rows.withColumn("parent_key", F.when(F.size("key") > n, F.slice("key", 1, n)).otherwise(F.col("parent_key")))


def leaves(rows: DataFrame) -> DataFrame:
    """Rows below which nothing was emitted."""
    parents = rows.select("root", F.col("parent_key").alias("key")).where("key is not null").distinct()
    return rows.join(parents, ["root", "key"], "left_anti")


def topped(rows: DataFrame, base: int = 1) -> DataFrame:
    """Rows with the result's columns; the start itself is no row, so parents of the first level are null."""
    return rows.withColumn("parent_key", F.when(F.size("parent_key") > base, F.col("parent_key"))).select(*ROW)


def in_order(rows: DataFrame) -> list[Column]:
    return [F.col("root"), F.col("key")]
