"""Relations between all notes of a group, held as note - group - note instead of an edge for each pair.

Notes of one folder, with one tag, with one value of a property, or with one target of a relation are tied to each other: n notes make n(n-1)
edges, but only n memberships. Steps, walks and sums over the others of a group work on memberships, in rows linear in notes and results.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.operators.common import anew, checkpointed, crossed


@dataclass(frozen=True)
class Groups:
    """A note of `left` (group, path) is tied to every other note of the same group in `right`. `once`: no two notes meet in more than one group."""

    left: DataFrame
    right: DataFrame
    once: bool = True

    def edges(self, relation: str) -> DataFrame:
        """(src, dst, relation) of every tie: as many rows as there are pairs. For small groups, and to test against."""
        a, b = self.left.select("group", F.col("path").alias("src")), self.right.select("group", F.col("path").alias("dst"))
        return a.join(b, "group").where("src <> dst").select("src", "dst", F.lit(relation).alias("relation")).distinct()

    def step(self, frontier: DataFrame) -> DataFrame:
        """(root, path): the notes tied to any of a root's notes (root, path); a note is not tied to itself, but may be to another of them.

        A group is crossed once for a root, whatever the number of its notes there: all members are met, but one that was there alone. Members
        are told apart for the roots alone that cross several groups; what one group gives is not shuffled.
        """
        asked = frontier.select("root", "path").distinct().join(self.left, "path").groupBy("root", "group").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
        asked = anew(asked)
        several = checkpointed(asked.groupBy("root").count().where("count > 1").select("root"))
        met = lambda some: crossed(some, self.right, "group").where("not (lo = hi and path = lo)").select("root", "path")
        if several.isEmpty():
            return met(asked)
        return met(asked.join(several, "root", "left_anti")).unionByName(met(asked.join(several, "root", "left_semi")).distinct())

    def reach(self, roots: DataFrame, depth: int | None = None) -> DataFrame:
        """(root, path, hops): the notes within `depth` steps (None: any number) of each root (column path), with the fewest steps.

        A root is among its results only if it is met again. Only crossings (root, group, hops) are kept, each group once for a root; what they meet
        is made at the end. From there on lead only notes with a further group; a root comes back by another note of a group of its own.
        """
        start = anew(roots.select(F.col("path").alias("root"), "path").where("path is not null").distinct())
        if depth is not None and depth < 1:
            return start.where("false").withColumn("hops", F.lit(0))
        alike = self.left is self.right
        left = anew(self.left.select("group", "path"))
        right = left if alike else anew(self.right.select("group", "path"))
        apart = right.groupBy("path").count().where("count > 1").isEmpty()
        fresh = anew(start.join(left, "path").select("root", "group", F.lit(1).alias("hops")))
        crossings, backs = [fresh], []
        if depth is None or depth > 1:
            # groups that a root is in on both sides, with the notes on both sides of them: two make it come back in two steps
            inside = left if alike else left.join(right, ["group", "path"], "left_semi")
            home = fresh.select("root", "group") if alike else anew(start.join(inside, "path").select("root", "group"))
            lone = inside.groupBy("group").count().where("count > 1").select("group")
            backs.append(home.join(lone, "group", "left_semi").select("root", F.col("root").alias("path"), F.lit(2).alias("hops")))
            # notes that come from one group and lead to another
            ways = right.join(left.select(F.col("group").alias("next"), "path"), "path").where("group <> next").select("group", "path").distinct()
            bridges = right.where("false") if alike and apart else anew(ways)
            seen = None
            for hops in count(2) if depth is None else range(2, depth + 1):
                if bridges.isEmpty():
                    break
                met = fresh.join(bridges, "group").where(F.lit(hops > 2) | (F.col("path") != F.col("root"))).select("root", "path").distinct()
                new = anew(met.join(seen, ["root", "path"], "left_anti") if seen is not None else met)
                if new.isEmpty():
                    break
                seen = new if seen is None else anew(seen.unionByName(new))
                asked = new.join(left, "path")
                backs.append(asked.where("path <> root").join(home, ["root", "group"], "left_semi").select("root", F.col("root").alias("path"), F.lit(hops).alias("hops")))
                known = reduce(DataFrame.unionByName, crossings).select("root", "group")
                fresh = anew(asked.select("root", "group").distinct().join(known, ["root", "group"], "left_anti").withColumn("hops", F.lit(hops)))
                crossings.append(fresh)
        met = crossed(reduce(DataFrame.unionByName, crossings), right, "group").where("hops > 1 or path <> root").select("root", "path", "hops")
        back = reduce(DataFrame.unionByName, backs) if backs else start.where("false").withColumn("hops", F.lit(0))
        if len(crossings) == 1 and apart:
            return met.unionByName(back.distinct())
        return met.unionByName(back).groupBy("root", "path").agg(F.min("hops").alias("hops"))

    def others(self, values: DataFrame, value: str) -> DataFrame:
        """(path, count, sum, least, greatest) over a value of the notes that each note of `left` is tied to, itself left out.

        `values` has one row for each note (path, value); notes without a row, or with null, count but add nothing. A note that is tied to
        none has count 0 and nulls. Sums are the group's less the note's own; least and greatest are the group's, or its second where the note holds the first.
        """
        if not self.once:
            raise ValueError("notes may meet in several groups, so that sums would count them more than once")
        v = values.select("path", F.col(value).alias("v"))
        members = checkpointed(self.right.join(v, "path", "left"))
        low, high = F.struct(F.col("v"), F.col("path")), F.struct(F.col("v"), F.col("path"))
        there = F.col("v").isNotNull()
        one = members.groupBy("group").agg(
            F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min(F.when(there, low)).alias("lo"), F.max(F.when(there, high)).alias("hi"), F.count("v").alias("k")
        )
        rest = members.join(one.select("group", "lo", "hi"), "group").groupBy("group").agg(
            F.min(F.when(F.col("path") != F.col("lo.path"), F.col("v"))).alias("lo2"), F.max(F.when(F.col("path") != F.col("hi.path"), F.col("v"))).alias("hi2")
        )
        own = self.left.join(v, "path", "left").join(self.right.select("group", "path").withColumn("inside", F.lit(True)), ["group", "path"], "left")
        full = own.join(one, "group", "left").join(rest, "group", "left")
        inside, mine = F.coalesce("inside", F.lit(False)), F.col("v").isNotNull()
        k = F.coalesce("k", F.lit(0)) - F.when(inside & mine, 1).otherwise(0)
        each = full.select(
            "path", (F.coalesce("n", F.lit(0)) - F.when(inside, 1).otherwise(0)).alias("n"), k.alias("k"),
            F.when(k > 0, F.col("s") - F.when(inside & mine, F.col("v")).otherwise(0)).alias("s"),
            F.when(inside & (F.col("lo.path") == F.col("path")), F.col("lo2")).otherwise(F.col("lo.v")).alias("lo"),
            F.when(inside & (F.col("hi.path") == F.col("path")), F.col("hi2")).otherwise(F.col("hi.v")).alias("hi"),
        )
        return each.groupBy("path").agg(F.sum("n").alias("count"), F.sum("s").alias("sum"), F.min("lo").alias("least"), F.max("hi").alias("greatest"))


def _alike(members: DataFrame, once: bool = True) -> Groups:
    kept = members.where("group is not null and path is not null").distinct()
    return Groups(kept, kept, once)


def folder_siblings(notes: DataFrame) -> Groups:
    """Notes of the same folder."""
    return _alike(notes.select(F.col("folder").alias("group"), "path"))


def folder_children(notes: DataFrame) -> Groups:
    """From each note to those in folders below its own, however deep; from the top folder (`/`) to all that aren't in it."""
    own = notes.where("folder is not null and path is not null").select(F.col("folder").alias("group"), "path").distinct()
    steps = F.split("group", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    inner = own.where("group <> '/'").select("path", F.explode(F.array_append(F.filter(above, lambda g: (g != F.col("group")) & (g != "")), F.lit("/"))).alias("group"))
    return Groups(own, inner.select("group", "path"))


def same_tag(notes: DataFrame, tag: str) -> Groups:
    """Notes that share a tag."""
    return _alike(notes.where(F.array_contains("tags", tag)).select(F.lit(tag).alias("group"), "path"))


def same_property(notes: DataFrame, key: str) -> Groups:
    """Notes with the same value of a property; of a list, with a value in common. A null is no value."""
    if notes.schema[key].dataType.typeName() == "array":
        return _alike(notes.select(F.explode(F.col(key).cast("array<string>")).alias("group"), "path"), once=False)
    return _alike(notes.select(F.col(key).cast("string").alias("group"), "path"))


def same_target(edges: DataFrame, relation: str) -> Groups:
    """Notes with an edge of a relation to the same note, as the sibling rules tie them."""
    return _alike(edges.where(F.col("relation") == relation).select(F.col("dst").alias("group"), F.col("src").alias("path")), once=False)
