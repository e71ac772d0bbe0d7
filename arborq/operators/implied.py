"""Implied edges: each rule (base, implied, direction) adds edges for the explicit ones of its base relation.

Directions: forward, reverse, both, and sibling (notes that share a target, or a source, get edges both ways).
One pass over explicit edges; no implied edge takes the place of an explicit one between the same notes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.operators.common import ranked
from arborq.operators.edges import EDGE_COLUMNS


@dataclass(frozen=True)
class Rule:
    base: str
    implied: str
    direction: str


def candidates(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """Candidate edges in the order of their making: per-edge rules, shared targets, shared sources."""
    spark = edges.sparkSession
    if unknown := {r.direction for r in rules} - {"forward", "reverse", "both", "sibling"}:
        raise ValueError(f"unknown directions {sorted(unknown)}")
    table = spark.createDataFrame([(r.base, r.implied, r.direction, i) for i, r in enumerate(rules)], "relation string, implied_rel string, direction string, rule int")
    ruled = edges.join(F.broadcast(table), "relation")
    ends = lambda a, b, turn: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(turn).alias("turn"))
    same, back = ends("src", "dst", 0), ends("dst", "src", 1)
    ways = F.when(F.col("direction") == "forward", F.array(same)).when(F.col("direction") == "reverse", F.array(back)).otherwise(F.array(same, back))
    each = (
        ruled.where("direction <> 'sibling'")
        .withColumn("e", F.explode(ways))
        .select("e.src", "e.dst", F.col("implied_rel").alias("relation"), F.col("relation").alias("implied_from"), F.lit(0).alias("stage"), "ord", "rule", "e.turn")
    )
    siblings = ruled.where("direction = 'sibling'")
    found = each
    for stage, shared, end in ((1, "dst", "src"), (2, "src", "dst")):
        a = siblings.select(F.col(shared).alias("at"), "relation", "implied_rel", "rule", F.col(end).alias("a"), F.col("label").alias("a_label"), F.col("ord").alias("a_ord"))
        b = siblings.select(F.col(shared).alias("at"), "relation", "implied_rel", "rule", F.col(end).alias("b"), F.col("label").alias("b_label"), F.col("ord").alias("b_ord"))
        place = lambda n, o, lab: F.struct(F.col(o), F.col(n), F.coalesce(F.col(lab), F.lit("")))
        pairs = a.join(b, ["at", "relation", "implied_rel", "rule"]).where(place("a", "a_ord", "a_label") < place("b", "b_ord", "b_label"))
        both = pairs.withColumn("e", F.explode(F.array(ends("a", "b", 0), ends("b", "a", 1))))
        found = found.unionByName(
            both.select("e.src", "e.dst", F.col("implied_rel").alias("relation"), F.col("relation").alias("implied_from"), F.lit(stage).alias("stage"), F.col("a_ord").alias("ord"), "rule", "e.turn")
        )
    return found


def with_implied(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """Explicit edges and what the rules imply: per (src, dst, relation) the first candidate, unless an explicit edge covers it.

    Implied edges carry no label and follow the explicit ones of their source; ord is the candidate's, kept
    apart by stage. Sibling rules fan out with the square of a shared note's edges: use them on relations whose notes
    share few.
    """
    explicit = edges.select(*EDGE_COLUMNS)
    if not rules:
        return explicit
    first = (
        candidates(explicit.where(~F.col("implied")), rules)
        .groupBy("src", "dst", "relation")
        .agg(F.min(F.struct("stage", "ord", "rule", "turn", "implied_from")).alias("c"))
    )
    covered = explicit.where(~F.col("implied")).select("src", "dst", "relation").distinct()
    new = first.join(covered, ["src", "dst", "relation"], "left_anti").select(
        "src", "dst", "relation", F.lit(None).cast("string").alias("label"), F.lit(True).alias("implied"), F.col("c.implied_from").alias("implied_from"), F.col("c.ord").alias("ord")
    )
    return explicit.unionByName(new)


def renumbered(edges: DataFrame) -> DataFrame:
    """Give ord its uniqueness within (src, relation): explicit edges first, then by the old ord and the target."""
    order = [F.col("implied").asc(), F.col("ord").asc(), F.col("dst").asc(), F.coalesce("label", F.lit("")).asc()]
    return ranked(edges, ["src", "relation"], order, "_ord").withColumn("ord", F.col("_ord")).drop("_ord")
