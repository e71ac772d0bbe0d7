"""Edge tables: columns src, dst, relation, label, implied, implied_from, ord.

ord orders the edges of one source and relation; it is unique among these.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborq.operators.common import anew, checkpointed

EDGE_COLUMNS = ["src", "dst", "relation", "label", "implied", "implied_from", "ord"]


def outgoing(edges: DataFrame, nodes: DataFrame, relation: str | None = None, label: str | None = None) -> DataFrame:
    """Edges that leave the nodes (column path), of one relation and label if given."""
    return _kept(edges, relation, label).join(nodes.select(F.col("path").alias("_n")).distinct(), F.col("src") == F.col("_n"), "left_semi")


def incoming(edges: DataFrame, nodes: DataFrame, relation: str | None = None, label: str | None = None) -> DataFrame:
    return _kept(edges, relation, label).join(nodes.select(F.col("path").alias("_n")).distinct(), F.col("dst") == F.col("_n"), "left_semi")


def _kept(edges: DataFrame, relation: str | None, label: str | None) -> DataFrame:
    if relation is not None:
        edges = edges.where(F.col("relation") == relation)
    return edges.where(F.col("label") == label) if label is not None else edges


def backlink_rows(notes: DataFrame) -> DataFrame:
    """(source, target): each note's link targets, once. The form for joins, as a target may have any number of sources."""
    return notes.select(F.col("path").alias("source"), F.explode("links").alias("target")).distinct()


def backlinks(notes: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """(path, backlinks): for each link target the sorted notes that link to it, as an array for notes that are shown (column path; default all)."""
    links = backlink_rows(notes)
    if shown is not None:
        links = links.join(shown.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return links.groupBy(F.col("target").alias("path")).agg(F.array_sort(F.collect_list("source")).alias("backlinks"))


def rename(edges: DataFrame, renames: DataFrame) -> DataFrame:
    """Rewrite both ends by a table (old, new)."""
    a = renames.select(F.col("old").alias("_old_s"), F.col("new").alias("_new_s"))
    b = renames.select(F.col("old").alias("_old_d"), F.col("new").alias("_new_d"))
    joined = edges.join(a, F.col("src") == F.col("_old_s"), "left").join(b, F.col("dst") == F.col("_old_d"), "left")
    ends = {"src": F.coalesce("_new_s", "src"), "dst": F.coalesce("_new_d", "dst")}
    return joined.select(*(ends.get(c, F.col(c)).alias(c) for c in edges.columns))


def delete(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop all edges from and to the notes in `gone` (column path)."""
    paths = gone.select(F.col("path").alias("_gone")).distinct()
    return edges.join(paths, F.col("src") == F.col("_gone"), "left_anti").join(paths, F.col("dst") == F.col("_gone"), "left_anti")


def relation_types(edges: DataFrame, configured: list[str]) -> DataFrame:
    """(relation, place): configured relations in their order, then the others met, by name."""
    spark = edges.sparkSession
    first = spark.createDataFrame([(r, i) for i, r in enumerate(configured)], "relation string, place int")
    met = edges.select("relation").distinct().join(first, "relation", "left_anti").withColumn("place", F.lit(len(configured)))
    return first.unionByName(met)


def ancestors(edges: DataFrame, roots: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """(root, path, depth, via, implied, implied_from): breadth-first along incoming edges, each note once for a root.

    A note is told by the first edge that leads to it: from the notes of a level in the order in which they were found, and for
    each by ord, whatever the relation (equal ones by source, then relation).
    """
    kept = edges.where(F.col("relation").isin(relations)) if relations else edges
    kept = checkpointed(kept.select(F.col("dst").alias("_at"), F.col("src").alias("path"), F.col("relation").alias("via"), "implied", "implied_from", "ord"))
    start = roots.select(F.col("path").alias("root"), F.col("path")).distinct()
    none = F.array().cast("array<struct<ord:bigint,path:string>>")
    seen, frontier, levels = start, start.withColumn("place", none), []
    for depth in count(1):
        place = F.concat("place", F.array(F.struct("ord", "path")))
        met = frontier.select("root", F.col("path").alias("_at"), "place").join(kept, "_at")
        nearest = met.groupBy("root", "path").agg(F.min(F.struct(place.alias("place"), "via", "implied", "implied_from")).alias("e"))
        level = anew(nearest.join(seen, ["root", "path"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        levels.append(level)
        frontier = level.select("root", "path", "e.place")
        seen = seen.unionByName(frontier.select("root", "path"))
        if depth % 32 == 0:
            seen = checkpointed(seen)
    none = start.where("false").select("root", "path", F.lit(0).alias("depth"), F.lit("").alias("via"), F.lit(False).alias("implied"), F.lit("").alias("implied_from"))
    out = none
    for level in levels:
        out = out.unionByName(level.select("root", "path", "depth", "e.via", "e.implied", "e.implied_from"))
    return out


def property_filter(notes: DataFrame, key: str, op: str, value: str | None = None) -> Column:
    """The form's filters on a lower-cased key: equals, contains, exists and notExists (a null counts as there)."""
    name = key.lower()
    present = name in notes.columns
    if op in ("exists", "notExists"):
        return F.lit(present == (op == "exists"))
    if not present:
        return F.lit(False)
    listed = notes.schema[name].dataType.typeName() == "array"
    text = F.col(f"`{name}`") if listed else F.col(f"`{name}`").cast("string")
    if op == "equals":
        return F.coalesce(F.array_contains(text, value) if listed else text == value, F.lit(False))
    if op == "contains":
        return F.coalesce(F.exists(text, lambda x: F.contains(x, F.lit(value))) if listed else F.contains(text, F.lit(value)), F.lit(False))
    raise ValueError(f"unknown filter {op}")
