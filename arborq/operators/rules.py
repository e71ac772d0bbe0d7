"""Rules that imply edges from patterns, over each other's results and over their own.

    Rule("parents", Pattern([Hop("file", "up", "p")]), [Implies("file", "above", "p")])
    Rule("further", Pattern([Hop("file", "up", "p"), Hop("p", "above", "top")]), [Implies("file", "above", "top")])

A rule depends on those that imply relations of its pattern. Rules that depend on each other in a ring are one stratum; strata run
in the order of dependence, a ring until nothing new comes, and each round looks only for matches that hold an edge of the round before.
A rule that does no more than join a relation with itself is the relation's closure, and is made as such: each way is met by its two halves alone.
The rules of `operators.implied` stay what they are: one pass over explicit edges.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.operators.adjacency import closure
from arborq.operators.common import anew
from arborq.operators.edges import EDGE_COLUMNS
from arborq.operators.paths import Path
from arborq.operators.patterns import Hop, Pattern


@dataclass(frozen=True)
class Implies:
    """start >relation> end; with `both` also the way back."""

    start: str
    relation: str
    end: str
    both: bool = False


@dataclass(frozen=True)
class Rule:
    """name, the pattern or the name of the rule whose pattern (and limits) it takes, the edges implied, and the notes (tables of paths) that variables are limited to."""

    name: str
    pattern: Pattern | str
    implies: tuple[Implies, ...]
    within: tuple[tuple[str, DataFrame], ...] = ()

    def __init__(self, name: str, pattern: Pattern | str, implies, within: dict[str, DataFrame] | None = None):
        for key, value in (("name", name), ("pattern", pattern), ("implies", tuple(implies)), ("within", tuple((within or {}).items()))):
            object.__setattr__(self, key, value)


def resolved(rules: list[Rule]) -> list[Rule]:
    """Rules with patterns in place of names of other rules."""
    by = {r.name: r for r in rules}
    if len(by) != len(rules):
        raise ValueError("two rules have one name")

    def follow(rule: Rule, above: tuple[str, ...]) -> Rule:
        if isinstance(rule.pattern, Pattern):
            return rule
        if rule.pattern not in by or rule.pattern in above:
            raise ValueError(f"rule {rule.name} refers to {rule.pattern}, which {'leads back to it' if rule.pattern in above else 'is not there'}")
        other = follow(by[rule.pattern], (*above, rule.pattern))
        return Rule(rule.name, other.pattern, rule.implies, {**dict(other.within), **dict(rule.within)})

    done = [follow(r, (r.name,)) for r in rules]
    for r in done:
        if unknown := {v for i in r.implies for v in (i.start, i.end)} - set(r.pattern.variables):
            raise ValueError(f"rule {r.name}: no hop has the variables {sorted(unknown)}")
    return done


def _reads(hop: Hop) -> set[str]:
    return hop.via.relations() if isinstance(hop.via, Path) else {hop.via}


def strata(rules: list[Rule]) -> list[list[Rule]]:
    """Rules in groups: each group depends on none after it; the rules of one depend on each other in a ring."""
    writes = [{i.relation for i in r.implies} for r in rules]
    reads = [set().union(*(_reads(h) for h in r.pattern.hops)) for r in rules]
    n = len(rules)
    before = [{j for j in range(n) if writes[j] & reads[i]} for i in range(n)]
    all_before = [set(b) for b in before]
    for k in range(n):
        for i in range(n):
            if k in all_before[i]:
                all_before[i] |= all_before[k]
    groups = []
    for i in range(n):
        ring = sorted({i} | {j for j in all_before[i] if i in all_before[j]})
        if ring[0] == i:
            groups.append(ring)
    out: list[list[int]] = []
    while groups:
        laid = {i for g in out for i in g}
        ready = next(g for g in groups if all(all_before[i] <= laid | set(g) for i in g))
        groups.remove(ready)
        out.append(ready)
    return [[rules[i] for i in g] for g in out]


def _edges(rule: Rule, matches: DataFrame) -> DataFrame:
    """(src, dst, relation, rule) of a rule's matches."""
    ends = []
    for i in rule.implies:
        one = lambda a, b, i=i: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(i.relation).alias("relation"))
        ends += [one(i.start, i.end), *([one(i.end, i.start)] if i.both else [])]
    return matches.select(F.explode(F.array(*ends)).alias("e"), F.lit(rule.name).alias("rule")).select("e.*", "rule")


def _matched(rule: Rule, known: DataFrame, fresh: DataFrame | None, ring: set[str]) -> list[DataFrame]:
    """Edges of the rule's matches in known edges (src, dst, relation, label); with `fresh` only of matches that hold a fresh edge of the ring's relations."""
    within = dict(rule.within)
    asked = list(dict.fromkeys(v for i in rule.implies for v in (i.start, i.end)))
    turning = [i for i, h in enumerate(rule.pattern.hops) if _reads(h) & ring]
    if fresh is None or any(isinstance(rule.pattern.hops[i].via, Path) for i in turning):
        return [_edges(rule, rule.pattern.match(known, within, asked))]

    def pairs(hop: Hop, table: DataFrame) -> DataFrame:
        return Pattern([hop]).match(table).select(F.col(hop.start).alias("a"), F.col(hop.end).alias("b"))

    out = []
    for i in turning:
        each = [pairs(h, fresh if j == i else known) for j, h in enumerate(rule.pattern.hops)]
        out.append(_edges(rule, rule.pattern.match_links(each, within, asked)))
    return out


def _closes(rule: Rule) -> str | None:
    """The relation R of a rule R(a, b), R(b, c) -> R(a, c) without further conditions."""
    hops = rule.pattern.hops
    if len(hops) != 2 or rule.within or rule.pattern.distinct or len(rule.implies) != 1 or len(rule.pattern.variables) != 3:
        return None
    first, then = hops if hops[0].end == hops[1].start else hops[::-1]
    made = rule.implies[0]
    plain = all(isinstance(h.via, str) and h.via == made.relation and h.label is None and not h.undirected for h in hops)
    return made.relation if plain and not made.both and first.end == then.start and (made.start, made.end) == (first.start, then.end) else None


def with_rules(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """The edges, and those that the rules imply: each (src, dst, relation) once, unless an edge of the table already ties these notes.

    An implied edge has no label, and the first rule's name that made it (in the round in which it came, by name) as implied_from; ord is 0.
    Edges from a note to itself are made where a pattern allows it. Without rules or matches the table comes back as it is.
    """
    explicit = edges.select(*EDGE_COLUMNS)
    if not rules:
        return explicit
    known = anew(explicit.select("src", "dst", "relation", "label").where("src is not null and dst is not null").distinct())
    made: list[DataFrame] = []
    groups = strata(resolved(rules))
    for at, group in enumerate(groups):
        writes = {i.relation for r in group for i in r.implies}
        reads = set().union(*(_reads(h) for r in group for h in r.pattern.hops))
        if len(group) == 1 and (relation := _closes(group[0])) is not None:
            old = known.where(F.col("relation") == relation).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
            new = closure(old)[0].where("hops > 1").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(relation).alias("relation"), F.lit(group[0].name).alias("rule"))
            made.append(new)
            if at + 1 < len(groups):
                known = anew(known.unionByName(new.select("src", "dst", "relation", F.lit(None).cast("string").alias("label"))))
            continue
        fresh = None
        for _ in count():
            found = reduce(DataFrame.unionByName, [m for r in group for m in _matched(r, known, fresh, writes)])
            one = found.groupBy("src", "dst", "relation").agg(F.min("rule").alias("rule"))
            old = known.select("src", "dst", "relation").distinct()
            new = anew(one.join(old, ["src", "dst", "relation"], "left_anti"))
            if new.isEmpty():
                break
            made.append(new)
            fresh = new.select("src", "dst", "relation", F.lit(None).cast("string").alias("label"))
            known = anew(known.unionByName(fresh))
            if not writes & reads:
                break
    if not made:
        return explicit
    implied = reduce(DataFrame.unionByName, made).select(
        "src", "dst", "relation", F.lit(None).cast("string").alias("label"), F.lit(True).alias("implied"), F.col("rule").alias("implied_from"), F.lit(0).cast("long").alias("ord")
    )
    return explicit.unionByName(implied)
