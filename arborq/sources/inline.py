"""Relations written inside note texts, by one pass of a scanner.

    rel::[[A]]  this note to A        [[A]]::rel  A to this note        [[A]]::rel::[[B]]  A to B
    ::[[C]]  the current source to C         ::-::[[C]]  the last target to C

A relation may carry a label after a dot. The scanner is per-row Python on Arrow batches; resolving links and
names to edges is left to joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The form of a relation name with its label, of a link and of a valid name.
NAME = r"[a-z0-9][a-z0-9_-]*(?:\.[a-z0-9][a-z0-9_-]*)*"
LINK = r"\[\[([^\]]+)\]\]"
# At one place the more specific form wins; a match that is taken uses up its text.
SCANNER = re.compile(
    rf"(?P<triple>{LINK}::\s*({NAME})\s*::\s*{LINK})|(?P<chain>::-::\s*{LINK})|(?P<more>::\s*{LINK})|(?P<prefix>({NAME})::\s*{LINK})|(?P<suffix>{LINK}::\s*({NAME}))",
    re.I,
)
VALID = re.compile(r"[a-z0-9][a-z0-9_-]*\Z")
PARSED = pa.struct([("source", pa.string()), ("relation", pa.string()), ("label", pa.string()), ("target", pa.string()), ("pos", pa.int64())])
PARSED_TYPE = "array<struct<source:string,relation:string,label:string,target:string,pos:bigint>>"


def link_target(text: str) -> str:
    """The note a link names: no alias, no heading, trimmed."""
    m = re.search(r"\[\[(.+?)\]\]", text)
    return (m[1] if m else text).split("|")[0].split("#")[0].strip()


def _marks(content: str) -> Iterator[re.Match]:
    """The scanner's matches, without a look at text that can't begin one.

    Each has `::` after a name, after a link or at its start; neither name nor link (up to its own end) holds a `]`. So none that
    takes the next `::` begins before the last `]` ahead of it, that of a link right there aside.
    """
    at = 0
    while (colons := content.find("::", at)) >= 0:
        link = content.startswith("]]", colons - 2) and colons - 2 >= at
        m = SCANNER.search(content, max(at, content.rfind("]", at, colons - 2 if link else colons) + 1))
        if m is None:
            return
        yield m
        at = m.end()


def relations_of(content: str | None, allowed: frozenset[str] | None = None) -> list[dict]:
    """Relations of one text in their order, each once; source or target None is the note itself."""
    marks = []
    for m in _marks(content or ""):
        g, kind = [g for g in m.groups()[1:] if g is not None], m.lastgroup
        parts = (g[-3], g[-2], g[-1]) if kind == "triple" else (None, g[-2], g[-1]) if kind == "prefix" else (g[-2], g[-1], None) if kind == "suffix" else (None, None, g[-1])
        marks.append((kind, m.start(), m.end(), *parts))
    found: dict[tuple, dict] = {}
    current: tuple[str | None, str, str | None] | None = None
    last: str | None = None
    for i, (kind, _, end, source, name, target) in enumerate(marks):
        src = link_target(source) if source else None
        dst = link_target(target) if target else None
        if (source and not src) or (target and not dst):
            continue
        if name is not None:
            relation, _, label = name.strip().lower().partition(".")
            if not VALID.match(relation) or (allowed is not None and relation not in allowed):
                continue
            current, last = (src, relation, label or None), dst
            emit = kind != "suffix" or not _goes_on(marks[i + 1 :], end)
        elif current is None:
            continue
        else:
            src, emit = (current[0] if kind == "more" else last), True
            last = dst
        if emit:
            key = (src, current[1], current[2], dst)
            found.setdefault(key, {"source": src, "relation": current[1], "label": current[2], "target": dst, "pos": len(found)})
    return list(found.values())


def _goes_on(following: list[tuple], end: int) -> bool:
    """Is the next mark after a gap, chains aside, a fan-out? One directly at the end doesn't count."""
    for kind, start, *_ in following:
        if start > end and kind != "chain":
            return kind == "more"
    return False


def parse_inline(notes: DataFrame, content: str = "content", allowed: list[str] | None = None, out: str = "relations") -> DataFrame:
    """Add an array of the relations in each note's text; null texts have none."""
    notes = notes.drop(out)
    columns, at = notes.columns, notes.columns.index(content)
    only = frozenset(a.lower() for a in allowed) if allowed is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [relations_of(t, only) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(PARSED))], [*columns, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.schema.fields)
    return notes.mapInArrow(run, f"{schema}, `{out}` {PARSED_TYPE}")


def prefix_only(notes: DataFrame, content: str = "content") -> DataFrame:
    """(path, relation, target) of `rel::[[A]]` alone, in Spark functions: enough where no other form occurs."""
    each = F.regexp_extract_all(F.col(content), F.lit(r"([A-Za-z0-9][A-Za-z0-9_-]*)::\s*\[\[([^\]]+)\]\]"), F.lit(0))
    one = notes.select("path", F.explode(each).alias("m"))
    return one.select("path", F.lower(F.regexp_extract("m", r"^([A-Za-z0-9][A-Za-z0-9_-]*)::", 1)).alias("relation"), normalised(F.regexp_extract("m", r"\[\[([^\]]+)\]\]", 1)).alias("target"))


def normalised(link: Column) -> Column:
    """link_target() of one link's inside, in Spark functions."""
    return F.trim(F.substring_index(F.substring_index(link, "|", 1), "#", 1))
