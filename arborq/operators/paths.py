"""Paths with quantifiers: which notes can be reached by relations in a given order, repeated as often as asked.

    step("up").plus()                        one or more
    step("up") >> step("down").star()        a parent, or anything below it
    (step("up") >> step("same")).times(1, 3)
    step("link", way="either").plus()        along edges in either direction

A path becomes an automaton. All roots walk together over triples (root, state, note): a step meets the index of edges, new
triples are those not seen before, so cycles end, and a note counts once whatever the number of ways to it. Where many roots come to few
notes by their first step, these notes walk in their place, and each root takes what its notes reach. Long walks go on by
jumps: what lies within some steps of every note is put together once, as far as that stays a few times the edges.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborq.operators.adjacency import IN, OUT, Adjacency, closure, index
from arborq.operators.common import anew, checkpointed, crossed

STRIDE, FOLDED, MAX_STATES = 3, 8, 4096
MANY, FEWER = 1 << 12, 4  # rows of a first step, and how many times the notes they come to, from which these walk in the roots' place
JUMP, ROOM, LEAST = 2, 24, 64  # strides before jumps, jumps' rows by edges, edges by rows of the frontier up to which they are made


@dataclass(frozen=True)
class Path:
    """A step, or paths one after the other (`then`), side by side (`either`), or repeated from `low` to `high` times (None: without limit)."""

    kind: str
    parts: tuple[Path, ...] = ()
    relation: str = ""
    label: str | None = None
    way: str = "out"
    low: int = 1
    high: int | None = 1

    def __rshift__(self, other: Path) -> Path:
        return Path("then", (self, other))

    def __or__(self, other: Path) -> Path:
        return Path("either", (self, other))

    def times(self, low: int, high: int | None) -> Path:
        if low < 0 or (high is not None and high < max(low, 1)):
            raise ValueError(f"no number of times: {low} to {high}")
        return Path("times", (self,), low=low, high=high)

    def opt(self) -> Path:
        return self.times(0, 1)

    def plus(self) -> Path:
        return self.times(1, None)

    def star(self) -> Path:
        return self.times(0, None)

    def relations(self) -> set[str]:
        return {self.relation} if self.kind == "step" else set().union(*(p.relations() for p in self.parts))

    def ways(self) -> set[int]:
        if self.kind == "step":
            return {"out": {OUT}, "in": {IN}, "either": {OUT, IN}}[self.way]
        return set().union(*(p.ways() for p in self.parts))


def step(relation: str, label: str | None = None, way: str = "out") -> Path:
    """One hop: along the edge, against it (`in`), or either."""
    if way not in ("out", "in", "either"):
        raise ValueError(f"unknown way {way}")
    return Path("step", relation=relation, label=label, way=way)


@dataclass
class Automaton:
    """moves: (state, way, relation, label, next), without empty moves; state 0 is the first; `ends` are the accepting states."""

    moves: list[tuple[int, int, str, str | None, int]] = field(default_factory=list)
    ends: set[int] = field(default_factory=set)

    @classmethod
    def of(cls, path: Path) -> Automaton:
        empty: dict[int, set[int]] = {0: set()}
        moves: list[tuple[int, int, str, str | None, int]] = []

        def new() -> int:
            if len(empty) >= MAX_STATES:
                raise ValueError("the path has too many states")
            empty[len(empty)] = set()
            return len(empty) - 1

        def lay(p: Path, at: int) -> int:
            """Put p in after a state; the state in which it ends."""
            if p.kind == "step":
                end = new()
                moves.extend((at, way, p.relation, p.label, end) for way in sorted(p.ways()))
                return end
            if p.kind == "then":
                return reduce(lambda a, q: lay(q, a), p.parts, at)
            if p.kind == "either":
                end = new()
                for q in p.parts:
                    empty[lay(q, at)].add(end)
                return end
            body = p.parts[0]
            for _ in range(p.low):
                at = lay(body, at)
            if p.high is None:
                begin = new()
                empty[at].add(begin)
                empty[lay(body, begin)].add(begin)
                return begin
            end = new()
            empty[at].add(end)
            for _ in range(p.high - p.low):
                at = lay(body, at)
                empty[at].add(end)
            return end

        last = lay(path, 0)

        def closure(state: int) -> set[int]:
            seen, todo = {state}, [state]
            while todo:
                for nxt in empty[todo.pop()] - seen:
                    seen.add(nxt)
                    todo.append(nxt)
            return seen

        around = {s: closure(s) for s in empty}
        full = {(s, way, rel, label, t) for s in around for (f, way, rel, label, t) in moves if f in around[s]}
        ends = {s for s in around if last in around[s]}
        live = set(ends)  # states from which an end can be reached
        while more := {m[0] for m in full if m[4] in live} - live:
            live |= more
        met, todo = {0}, [0]
        while todo:
            at = todo.pop()
            for m in full:
                if m[0] == at and m[4] in live and m[4] not in met:
                    met.add(m[4])
                    todo.append(m[4])
        kept = [m for m in full if m[0] in met and m[4] in live]
        like = cls._alike(met | ends & met, kept, ends) if len(met) <= 256 else {s: s for s in met}
        joined = {(like[m[0]], *m[1:4], like[m[4]]) for m in kept}
        return cls(sorted(joined, key=lambda m: (m[0], m[1], m[2], m[3] or "", m[4])), {like[s] for s in ends & met})

    @staticmethod
    def _alike(states: set[int], moves: list[tuple], ends: set[int]) -> dict[int, int]:
        """The least state that has the same way on as each: both ends or neither, and the same moves to states that are alike."""
        like = {s: min(t for t in states if (t in ends) == (s in ends)) for s in states}
        while True:
            signs = {s: (like[s], frozenset((*m[1:4], like[m[4]]) for m in moves if m[0] == s)) for s in states}
            least: dict[tuple, int] = {}
            for s in sorted(states):
                least.setdefault(signs[s], s)
            finer = {s: least[signs[s]] for s in states}
            if finer == like:
                return like
            like = finer

    def longest(self) -> int | None:
        """The number of steps of the longest walk; None where it can go round."""
        depth: dict[int, int] = {}

        def deep(s: int, above: frozenset[int]) -> int | None:
            if s in above:
                return None
            if s not in depth:
                below = [deep(m[4], above | {s}) for m in self.moves if m[0] == s]
                if None in below:
                    return None
                depth[s] = 1 + max(below) if below else 0
            return depth[s]

        return deep(0, frozenset())


def _by_state(machine: Automaton) -> Column:
    """The moves (way, relation, asked, next) of each state, as a literal map; states without one are not in it."""
    by: dict[int, list[Column]] = {}
    for state, way, relation, label, nxt in machine.moves:
        move = F.struct(F.lit(way).alias("way"), F.lit(relation).alias("relation"), F.lit(label).cast("string").alias("asked"), F.lit(nxt).alias("next"))
        by.setdefault(state, []).append(move)
    return F.create_map(*(x for state, some in by.items() for x in (F.lit(state), F.array(*some))))


def reach(edges: DataFrame | Adjacency, roots: DataFrame, path: Path, stride: int = STRIDE) -> DataFrame:
    """(root, path, hops): the notes that a walk along the path can reach from each root (column path), with the least number of hops.

    A path that can be empty includes the root with 0 hops; otherwise a root is among its results only if a walk leads
    back to it. Roots are taken once, null ones not at all; a root or a relation without edges gives nothing more. `stride`
    steps are one plan, then new triples are told from those seen and kept; a lost executor costs a stride.
    """
    machine = Automaton.of(path)
    graph = edges if isinstance(edges, Adjacency) else index(edges, path.relations(), tuple(sorted(path.ways())))
    start = roots.select(F.col("path").alias("root"), F.lit(0).alias("state"), F.col("path"), F.lit(0).alias("hops")).where("path is not null").distinct()
    if not machine.moves:
        return start.where(F.lit(0 in machine.ends)).select("root", "path", "hops")
    moves = _by_state(machine)
    return _walked(graph, machine, anew(start.select("root", "state", "path")), machine.longest(), _by_state(machine), stride)


def _step(graph: Adjacency, rows: DataFrame, moves: Column, *more: str) -> DataFrame:
    """One step of rows (root, state, path, more): root, next state, the note come to (path), the one left (at), more."""
    asked = rows.select("root", *more, F.col("path").alias("at"), F.inline(F.element_at(moves, F.col("state"))))
    return graph.neighbours(asked).where("asked is null or asked = label").select("root", F.col("next").alias("state"), F.col("to").alias("path"), "at", *more)


def _walked(graph: Adjacency, machine: Automaton, start: DataFrame, most: int | None, moves: Column, stride: int) -> DataFrame:
    """(root, path, hops) from starts (root, state, path), one for each root."""
    accepted = F.col("state").isin(sorted(machine.ends)) if machine.ends else F.lit(False)
    first = anew(_step(graph, start, moves).distinct())
    rows, ends = first.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct("state", "path"))).first()
    if rows >= MANY and rows >= FEWER * ends:
        return _by_entries(graph, machine, start, first, most, moves, stride)
    seen = [start.withColumn("hops", F.lit(0))]
    frontier = anew(first.select("root", "state", "path").join(start, ["root", "state", "path"], "left_anti").withColumn("hops", F.lit(1)))
    seen.append(frontier)
    done, rounds, jumps, far = 1, 0, None, 0
    while most is None or done < most:
        if rounds == JUMP and most is None:
            jumps, far = _jumps(graph, machine, frontier.count())
        if jumps is not None:
            met = frontier.withColumn("a", _vertex("state", "path")).select("root", "a", F.col("hops").alias("before")).join(jumps, "a")
            each = met.select("root", "state", "path", (F.col("before") + F.col("hops")).alias("hops"))
            new = each.groupBy("root", "state", "path").agg(F.min("hops").alias("hops"))
            new = anew(new.join(reduce(DataFrame.unionByName, seen), ["root", "state", "path"], "left_anti"))
            done = done + far if far else None
            frontier = new.where(F.col("hops") == F.lit(done))
        else:
            # laps, not hops, are written into the plan: it is the same in every round, and so is the code made for it
            levels, at = [], frontier.select("root", "state", "path", "hops")
            steps = stride if most is None else min(stride, most - done)
            for lap in range(1, steps + 1):
                at = _step(graph, at, moves, "hops").select("root", "state", "path", (F.col("hops") + 1).alias("hops"))
                levels.append(at.withColumn("lap", F.lit(lap)))
            done += steps
            least = reduce(DataFrame.unionByName, levels).groupBy("root", "state", "path").agg(F.min(F.struct("hops", "lap")).alias("m")).select("root", "state", "path", "m.*")
            new = anew(least.join(reduce(DataFrame.unionByName, seen), ["root", "state", "path"], "left_anti"))
            frontier, new = new.where(F.col("lap") == steps).drop("lap"), new.drop("lap")
        rounds += 1
        if new.isEmpty():
            break
        seen.append(new)
        if done is None:
            break
        if len(seen) > FOLDED:
            seen = [anew(reduce(DataFrame.unionByName, seen))]
    reached = reduce(DataFrame.unionByName, seen).where(accepted)
    return reached.groupBy("root", "path").agg(F.min("hops").alias("hops"))


def _by_entries(graph: Adjacency, machine: Automaton, start: DataFrame, first: DataFrame, most: int | None, moves: Column, stride: int) -> DataFrame:
    """As _walked, where many roots came to few notes by the first step (root, state, path, at): these walk, each once, and the roots take what they reach."""
    entry = _vertex("state", "path")
    entries = anew(first.select(entry.alias("root"), "state", "path").distinct())
    below = anew(_walked(graph, machine, entries, None if most is None else most - 1, moves, stride).withColumnRenamed("root", "entry"))
    ties = first.select("root", F.col("at").alias("own"), entry.alias("entry"))
    empty = start.where(F.col("state").isin(sorted(machine.ends)) if machine.ends else F.lit(False)).select("root", "path", F.lit(0).alias("hops"))
    none = empty.isEmpty()
    out = crossed(ties, below, "entry").where(F.lit(True) if none else F.col("path") != F.col("own")).select("root", "path", (F.col("hops") + 1).alias("hops"))
    if not ties.groupBy("root").count().where("count > 1").isEmpty():
        out = out.groupBy("root", "path").agg(F.min("hops").alias("hops"))
    return out if none else out.unionByName(empty)


def _vertex(state: str, path: str) -> Column:
    return F.concat_ws("\0", F.col(state).cast("string"), F.col(path))


def _jumps(graph: Adjacency, machine: Automaton, frontier: int) -> tuple[DataFrame | None, int | None]:
    """(a, state, path, hops): what lies within so many steps of each state and note (a), and how many (None: all), if that is worth while."""
    if len(machine.moves) > LEAST:
        return None, 0
    named = F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(m, ("int", "int", "string", "string", "int"), ("state", "_way", "_relation", "asked", "next"), strict=True))) for m in machine.moves))
    place = F.split("place", "\0")
    rows = graph.rows.select(place[0].cast("int").alias("way"), place[1].alias("relation"), F.array_join(F.slice(place, F.lit(3), F.size(place) - 3), "\0").alias("at"), "to", "label")
    each = rows.select("*", F.inline(named)).where("way = _way and relation = _relation and (asked is null or asked = label)")
    pairs = checkpointed(each.select(_vertex("state", "at").alias("a"), _vertex("next", "to").alias("b")).distinct())
    if pairs.count() > LEAST * frontier:
        return None, 0
    near, far = closure(pairs, ROOM)
    if far is not None and far < 2 * STRIDE:
        return None, 0
    state = F.substring_index("b", "\0", 1)
    return near.select("a", state.cast("int").alias("state"), F.expr("substring(b, length(substring_index(b, '\0', 1)) + 2)").alias("path"), "hops"), far
