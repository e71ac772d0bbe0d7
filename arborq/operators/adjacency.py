"""An index of edges by note: each direction, relation and note has its neighbours in known partitions.

The rows are dealt and sorted by their place (way, relation, note and part, as one text) once and kept; a join with them moves
and sorts the other side alone, at every step of a walk. A note with more neighbours than HEAVY has them in several parts, in partitions of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborq.operators.common import anew, checkpointed

OUT, IN = 0, 1
HEAVY = 1 << 16


def place(part: Column) -> Column:
    return F.concat_ws("\0", "way", "relation", "at", part)


@dataclass(frozen=True)
class Adjacency:
    """rows: place, to, label; heavy: way, relation, at, parts of the notes with more than one part, None where there are none."""

    rows: DataFrame
    heavy: DataFrame | None
    partitions: int

    def neighbours(self, asked: DataFrame) -> DataFrame:
        """Rows asked (columns way, relation and at among others), equal ones once, joined with each neighbour: adds to and label.

        They are dealt by place, which serves the join and the telling of equal rows alike, so a step of a walk is one shuffle of its frontier.
        """
        split = asked.withColumn("place", place(F.lit(0)))
        if self.heavy is not None:
            parts = F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))
            split = asked.join(self.heavy, ["way", "relation", "at"], "left").withColumn("part", F.explode(parts)).withColumn("place", place(F.col("part"))).drop("parts", "part")
        return split.repartition(self.partitions, "place").distinct().join(self.rows, "place").drop("place")


def index(edges: DataFrame, relations: set[str] | None = None, ways: tuple[int, ...] = (OUT, IN), heavy: int = HEAVY) -> Adjacency:
    """The index of the edges of some relations. Edges without an end are in none; repeated edges are there once for each label."""
    kept = edges.where("src is not null and dst is not null")
    if relations is not None:
        kept = kept.where(F.col("relation").isin(sorted(relations)))
    ends = {OUT: ("src", "dst"), IN: ("dst", "src")}
    both = F.array(*(F.struct(F.lit(w).alias("way"), F.col(ends[w][0]).alias("at"), F.col(ends[w][1]).alias("to")) for w in ways))
    each = checkpointed(kept.select(F.explode(both).alias("e"), "relation", "label").select("e.way", "relation", "e.at", "e.to", "label").distinct())
    sizes = each.groupBy("way", "relation", "at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy)
    many = checkpointed(sizes.select("way", "relation", "at", F.ceil(F.col("n") / heavy).cast("int").alias("parts")))
    cut = each.withColumn("part", F.lit(0))
    if split := not many.isEmpty():
        cut = each.join(many, ["way", "relation", "at"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("to"), F.col("parts")).cast("int"), F.lit(0)))
    rows = cut.select(place(F.col("part")).alias("place"), "to", "label")
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Adjacency(_kept_in_place(rows, n), many if split else None, n)


def _kept_in_place(rows: DataFrame, n: int) -> DataFrame:
    """rows dealt and sorted by place, as a table whose partitioning later joins know. An adaptive plan doesn't tell it, so this one isn't."""
    conf = rows.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpointed(rows.repartition(n, "place").sortWithinPartitions("place"))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def closure(pairs: DataFrame, most: float | None = None) -> tuple[DataFrame, int | None]:
    """(a, b, hops): the notes b that a walk along distinct pairs (a, b) leads to from a, with the length of the shortest; and how far that goes.

    By doubling: whatever lies S to 2S away is met by a walk of S and one of S at most. Only walks of exactly S are carried on, so that on
    chains each result is made once, and there are as many rounds as the greatest distance has binary digits. `most`: no round that would
    make more than so many times the pairs; the distance covered is told then, None where nothing is left out.
    """
    near = anew(pairs.select("a", "b", F.lit(1).alias("hops")))
    parts, last, far, base = [near], near, 1, near.count()
    while base:
        known = reduce(DataFrame.unionByName, parts)
        ahead = known.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("hops").alias("more"))
        if most is not None:
            ends, starts = last.groupBy("b").agg(F.count(F.lit(1)).alias("n")), ahead.groupBy("b").agg(F.count(F.lit(1)).alias("m"))
            if (ends.join(starts, "b").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0) > most * base:
                return known, far
        met = last.join(ahead, "b").select("a", F.col("c").alias("b"), (F.col("hops") + F.col("more")).alias("hops"))
        new = anew(met.groupBy("a", "b").agg(F.min("hops").alias("hops")).join(known, ["a", "b"], "left_anti"))
        far *= 2
        if new.isEmpty():
            break
        parts.append(new)
        last = new.where(F.col("hops") == far)
    return reduce(DataFrame.unionByName, parts), None
