"""Patterns with variables: all ways to put notes in place of variables so that every edge of the pattern is there.

    Pattern([Hop("file", "up", "parent"), Hop("parent", "same", "uncle")], distinct=[("uncle", "parent")]).match(edges)

Variables are bound one after the other. A new variable that several edges tie to bound ones gets its candidates, for
each partial match, from the edge with the fewest neighbours there; the others only confirm them. So a triangle through a
hub is found from its other corners, and nothing grows with the square of the hub's edges. Before that, notes
that can't take part are dropped by semi-joins along the pattern; in patterns without a cycle every partial match
that is left can be completed, so none of them is made in vain.
Matches are told apart only where they may be equal: not if what is left out of them is given by what they keep. Notes with
many partners meet the partial matches in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborq.operators.common import anew, crossed
from arborq.operators.paths import Path, reach

HEAVY = 1 << 16
WIDE = 1 << 8  # partners of a note from which its rows meet them in blocks


@dataclass(frozen=True)
class Hop:
    """start -via-> end, where via is a relation's name or a path with quantifiers; `undirected` takes the edge in either direction."""

    start: str
    via: str | Path
    end: str
    undirected: bool = False
    label: str | None = None


@dataclass(frozen=True)
class Links:
    """(a, b): the pairs that a hop allows, each once, with the number of partners of both ends."""

    pairs: DataFrame
    ends: tuple[str, str]

    def facing(self, known: str) -> DataFrame:
        """The pairs as (known, new)."""
        return self.pairs if known == self.ends[0] else self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))


@dataclass(frozen=True)
class Shape:
    """How many pairs a hop has, and about how many notes at its two ends."""

    rows: int
    starts: int
    ends: int


def _shape(pairs: DataFrame) -> Shape:
    return Shape(*pairs.agg(F.count(F.lit(1)), F.approx_count_distinct("a"), F.approx_count_distinct("b")).first())


@dataclass(frozen=True)
class Pattern:
    """hops to be found together, pairs of variables that have to differ, and conditions: (names of variables, condition over columns of these names)."""

    hops: tuple[Hop, ...]
    distinct: tuple[tuple[str, str], ...] = ()
    heavy: int = HEAVY

    def __init__(self, hops, distinct=(), heavy: int = HEAVY):
        if not hops:
            raise ValueError("a pattern has one hop at least")
        for key, value in (("hops", tuple(hops)), ("distinct", tuple(distinct)), ("heavy", heavy)):
            object.__setattr__(self, key, value)
        if unknown := {v for pair in self.distinct for v in pair} - set(self.variables):
            raise ValueError(f"no hop has the variables {sorted(unknown)}")

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for h in self.hops for v in (h.start, h.end)))

    def match(self, edges: DataFrame, within: dict[str, DataFrame] | None = None, select: list[str] | None = None) -> DataFrame:
        """One row for each match, a column for each variable (of `select`, distinct, if given).

        `within` limits variables to the notes of tables (column path), as the start notes of a query or those that meet a condition.
        Hops that no chain of hops ties together aren't allowed, as their matches would be all pairs. A hop from a variable to itself
        is a loop. Repeated edges count once, null ends never match; a relation without edges gives no match.
        """
        within = {v: d.select(F.col("path").alias("v")).where("v is not null").distinct() for v, d in (within or {}).items()}
        links = self._reduced([self._links(h, edges, within) for h in self.hops], within)
        return self._joined(links, within, select)

    def match_links(self, pairs: list[DataFrame], within: dict[str, DataFrame] | None = None, select: list[str] | None = None) -> DataFrame:
        """As `match`, with the pairs (a, b) of each hop given."""
        within = {v: d.select(F.col("path").alias("v")).where("v is not null").distinct() for v, d in (within or {}).items()}
        given = [Links(p.select("a", "b").where("a is not null and b is not null").distinct(), (h.start, h.end)) for h, p in zip(self.hops, pairs, strict=True)]
        return self._joined(self._reduced(given, within), within, select)

    def _links(self, hop: Hop, edges: DataFrame, within: dict[str, DataFrame]) -> Links:
        if isinstance(hop.via, Path):
            starts = within.get(hop.start)
            if starts is None:
                starts = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
            pairs = reach(edges, starts.select(F.col("v").alias("path")), hop.via).select(F.col("root").alias("a"), F.col("path").alias("b"))
        else:
            kept = edges.where(F.col("relation") == hop.via)
            kept = kept.where(F.col("label") == hop.label) if hop.label is not None else kept
            pairs = kept.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        if hop.undirected:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = pairs.where("a is not null and b is not null")
        if hop.start == hop.end:
            pairs = pairs.where("a = b")
        return Links(pairs.distinct(), (hop.start, hop.end))

    def _order(self) -> list[int]:
        """The hops so that each, after the first, shares a variable with those before."""
        left, out, met = list(range(len(self.hops))), [], set()
        while left:
            for i in left:
                if not out or {self.hops[i].start, self.hops[i].end} & met:
                    break
            else:
                raise ValueError("the pattern falls into parts that no hop ties together")
            left.remove(i)
            out.append(i)
            met |= {self.hops[i].start, self.hops[i].end}
        return out

    def _reduced(self, links: list[Links], within: dict[str, DataFrame]) -> list[Links]:
        """The pairs whose ends can take part: down the hops in order and back up, each limited by what its neighbour leaves of the shared variable.

        What is left of a variable only shrinks. So on the way back a hop is left as it is, and not written again, if both ends have as many notes as it left.
        """
        order = self._order()
        links = list(links)
        allowed: dict[str, DataFrame] = {v: d for v, d in within.items() if v in self.variables}
        maker: dict[str, int] = {}  # the hop that allowed[v] is from
        notes: dict[tuple[int, str], int] = {}

        def count(i: int, v: str) -> int:
            """The notes of a variable that a hop leaves."""
            if (i, v) not in notes:
                notes[i, v] = links[i].pairs.select(F.col("a" if v == links[i].ends[0] else "b")).distinct().count()
            return notes[i, v]

        for turn in (order, order[::-1]):
            for i in turn:
                if turn is not order and all(maker[v] == i or count(maker[v], v) == count(i, v) for v in links[i].ends):
                    continue
                kept = links[i].pairs
                for side, v in zip(("a", "b"), links[i].ends, strict=True):
                    if v in allowed:
                        kept = kept.join(allowed[v].select(F.col("v").alias(side)), side, "left_semi")
                kept = anew(kept.select("a", "b"))
                links[i] = Links(kept, links[i].ends)
                for side, v in zip(("a", "b"), links[i].ends, strict=True):
                    allowed[v], maker[v] = kept.select(F.col(side).alias("v")).distinct(), i
                    notes.pop((i, v), None)
        return links

    def _joined(self, links: list[Links], within: dict[str, DataFrame], select: list[str] | None) -> DataFrame:
        shapes = [_shape(link.pairs) for link in links]
        wanted = select if select is not None else self.variables
        first = min(range(len(links)), key=lambda i: (self._cost(shapes, i), not set(links[i].ends) & set(within), i))
        a, b = links[first].ends
        rows = links[first].pairs.select(F.col("a").alias(a), *([F.col("b").alias(b)] if b != a else []))
        bound, open_ = {a, b}, [i for i in range(len(links)) if i != first]
        rows = self._differ(rows, set(), bound)
        while open_:
            checks = [i for i in open_ if set(links[i].ends) <= bound]
            for i in checks:  # loops, and further hops between bound variables
                x, y = links[i].ends
                rows = rows.join(links[i].pairs.select(F.col("a").alias(x), *([F.col("b").alias(y)] if x != y else [])), list(dict.fromkeys((x, y))), "left_semi")
                open_.remove(i)
            if not open_:
                break
            new, ties = self._next(shapes, bound, open_)
            before = set(bound)
            rows = self._extended(rows, new, [(known, links[i].facing(known)) for known, i in ties])
            bound.add(new)
            open_ = [i for i in open_ if i not in {i for _, i in ties}]
            rows = self._differ(rows, before, bound)
            # variables that nothing asks for any more end here, so that rows which differ in them alone become one
            needed = {*wanted, *(v for pair in self.distinct if not set(pair) <= bound for v in pair), *(v for i in open_ for v in links[i].ends)}
            if not bound <= needed:
                rows = self._left(rows, [v for v in rows.columns if v in needed], links)
        return self._left(rows, wanted, links)

    def _left(self, rows: DataFrame, names: list[str], links: list[Links]) -> DataFrame:
        """Different rows (all are, before) with these variables alone: told apart unless each variable left out has one value by those that stay, over hops on which a note has one partner."""
        given, gone = set(names), set(rows.columns) - set(names)
        tried: set[tuple[int, str]] = set()
        while gone - given:
            ways = [(i, known, new) for i, link in enumerate(links) for known, new in (link.ends, link.ends[::-1]) if known in given and new in gone - given and (i, known) not in tried]
            if not ways:
                return rows.select(*names).distinct()
            i, known, new = ways[0]
            tried.add((i, known))
            if links[i].facing(known).groupBy("a").count().where("count > 1").isEmpty():
                given.add(new)
        return rows.select(*names)

    def _next(self, shapes: list[Shape], bound: set[str], open_: list[int]) -> tuple[str, list[tuple[str, int]]]:
        """The variable to bind next, and the hops that tie it to bound ones: the one with the fewest candidates for each partial match, as far as averages tell."""
        ties: dict[str, list[tuple[str, int]]] = {}
        for i in open_:
            x, y = self.hops[i].start, self.hops[i].end
            if (x in bound) != (y in bound):
                ties.setdefault(y if x in bound else x, []).append((x if x in bound else y, i))
        new = min(ties, key=lambda v: (self._fan(shapes, ties[v])[0], -len(ties[v]), v))
        return new, ties[new]

    def _fan(self, shapes: list[Shape], ties: list[tuple[str, int]]) -> tuple[float, float]:
        """Candidates for each partial match, and how many of them all ties confirm, on average."""
        fans = [shapes[i].rows / max(1, shapes[i].starts if self.hops[i].start == known else shapes[i].ends) for known, i in ties]
        least = min(range(len(fans)), key=fans.__getitem__)
        left = fans[least]
        for n, (_, i) in enumerate(ties):
            if n != least:
                left *= min(1.0, shapes[i].rows / max(1, shapes[i].starts * shapes[i].ends))
        return fans[least], left

    def _cost(self, shapes: list[Shape], first: int) -> float:
        """The rows of all steps if the pattern is begun with a hop, by the same averages."""
        rows = total = float(shapes[first].rows)
        bound, open_ = {self.hops[first].start, self.hops[first].end}, [i for i in range(len(self.hops)) if i != first]
        while open_ := [i for i in open_ if not {self.hops[i].start, self.hops[i].end} <= bound]:
            new, ties = self._next(shapes, bound, open_)
            fan, left = self._fan(shapes, ties)
            total, rows = total + rows * fan, rows * left
            bound.add(new)
        return total

    def _differ(self, rows: DataFrame, before: set[str], bound: set[str]) -> DataFrame:
        for x, y in self.distinct:
            if {x, y} <= bound and not {x, y} <= before:
                rows = rows.where(F.col(x) != F.col(y))
        return rows

    def _extended(self, rows: DataFrame, new: str, ties: list[tuple[str, DataFrame]]) -> DataFrame:
        """rows with a column for a new variable, which every tie (bound variable, pairs (a, b)) has to allow."""
        degrees = [pairs.groupBy(F.col("a").alias(f"_at{n}")).agg(F.count(F.lit(1)).alias(f"_n{n}")) for n, (_, pairs) in enumerate(ties)]
        if len(ties) == 1:
            known, pairs = ties[0]
            partners = pairs.select(F.col("a").alias(known), F.col("b").alias(new))
            if degrees[0].where(F.col("_n0") > WIDE).isEmpty():
                return rows.join(partners, known)
            return crossed(anew(rows), partners, known)
        for n, (known, _) in enumerate(ties):
            rows = rows.join(degrees[n], F.col(known) == F.col(f"_at{n}")).drop(f"_at{n}")
        counts = [F.col(f"_n{n}") for n in range(len(ties))]
        least = F.array_position(F.array(*counts), F.least(*counts)) - 1
        rows = anew(rows.withColumn("_by", least))
        out = []
        for n, (known, pairs) in enumerate(ties):
            mine = self._proposed(rows.where(F.col("_by") == n), new, known, pairs, degrees[n], f"_n{n}")
            for m, (other, confirming) in enumerate(ties):
                if m != n:
                    mine = mine.join(confirming.select(F.col("a").alias(other), F.col("b").alias(new)), [other, new], "left_semi")
            out.append(mine)
        return reduce(DataFrame.unionByName, out).drop("_by", *(f"_n{n}" for n in range(len(ties))))

    def _proposed(self, rows: DataFrame, new: str, known: str, pairs: DataFrame, degrees: DataFrame, n: str) -> DataFrame:
        """rows joined with the partners of `known`; a note of many partners has them in several parts, which its rows meet one by one."""
        parts = lambda c: F.ceil(F.col(c) / self.heavy).cast("int")
        size = degrees.columns[1]
        dealt = pairs.join(degrees.select(F.col(degrees.columns[0]).alias("_a"), F.col(size).alias("_size")), F.col("a") == F.col("_a"))
        dealt = dealt.select(F.col("a").alias(known), F.col("b").alias(new), F.pmod(F.xxhash64("b"), parts("_size")).cast("int").alias("_part"))
        split = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), parts(n) - 1)))
        return split.join(dealt, [known, "_part"]).drop("_part")


def conditions(notes: DataFrame, **wanted: Column) -> dict[str, DataFrame]:
    """`within` for variables whose notes meet a condition over the notes' columns."""
    return {v: notes.where(c).select("path") for v, c in wanted.items()}
