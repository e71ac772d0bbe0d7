"""Relations and properties from front-matter: the text of a block, or JSON (a nested object)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from arborq.sources import yaml
from arborq.sources.inline import PARSED, PARSED_TYPE, VALID, link_target

LABEL = re.compile(r"[a-z0-9][a-z0-9_-]*(?:\.[a-z0-9][a-z0-9_-]*)*\Z")


@dataclass(frozen=True)
class Relation:
    """A relation and the front-matter keys that stand for it."""

    name: str
    keys: tuple[str, ...]


def _places(node: Any, key: str) -> Iterator[tuple[Any, list[str]]]:
    """Values under `key`, or under `key.label`, anywhere in the tree, with the label's parts; found values are not searched."""
    if isinstance(node, list):
        for item in node:
            yield from _places(item, key)
    elif isinstance(node, dict):
        for k, v in node.items():
            name = k.lower()
            if name == key:
                yield v, []
            elif name.startswith(key + "."):
                parts = name[len(key) + 1 :].split(".")
                if all(LABEL.match(p) for p in parts):
                    yield v, parts
            else:
                yield from _places(v, key)


def _targets(value: Any, label: list[str]) -> Iterator[tuple[str, str | None]]:
    """Link targets below a value; keys of objects on the way are parts of the label."""
    if isinstance(value, dict):
        for k, v in value.items():
            if LABEL.match(k.lower()):
                yield from _targets(v, [*label, k.lower()])
        return
    for item in value if isinstance(value, list) else [value]:
        if isinstance(item, str) and (target := link_target(item)):
            yield target, ".".join(label) or None


def _heads(node: Any, out: set[str]) -> set[str]:
    """The names under which _places can find anything: each key of the tree, and what stands before a dot in it."""
    if isinstance(node, list):
        for item in node:
            _heads(item, out)
    elif isinstance(node, dict):
        for k, v in node.items():
            name = k.lower()
            out.add(name)
            while "." in name:
                name = name.rpartition(".")[0]
                out.add(name)
            _heads(v, out)
    return out


def relations_of(front: dict | None, relations: list[Relation]) -> list[dict]:
    found: dict[tuple, dict] = {}
    heads = _heads(front or {}, set())
    for r in relations:
        name = r.name.strip().lower()
        if not VALID.match(name):
            continue
        for key in dict.fromkeys(k.lower() for k in r.keys):
            if key not in heads:
                continue
            for value, label in _places(front or {}, key):
                for target, full in _targets(value, label):
                    found.setdefault((name, full, target), {"source": None, "relation": name, "label": full, "target": target, "pos": len(found)})
    return list(found.values())


def properties_of(front: dict | None, relations: list[Relation], nested: bool = True) -> dict:
    """Properties by lower-case key: scalars, nulls, the texts of arrays and (if nested) objects; relation keys are left out."""
    used = {k.lower() for r in relations for k in r.keys}
    kept = {}
    for k, v in (front or {}).items():
        key = k.lower()
        if key == "relations" or key in used or key.partition(".")[0] in used and "." in key:
            continue
        if isinstance(v, list):
            texts = [x for x in v if isinstance(x, str)]
            if texts:
                kept[key] = texts
        elif not isinstance(v, dict) or nested:
            kept[key] = v
    return kept


def parse_front_matter(notes: DataFrame, relations: list[Relation], front: str = "front_matter") -> DataFrame:
    """Add front_relations and properties_json; null or invalid front-matter has none."""
    notes = notes.drop("front_relations", "properties_json")
    columns, at = notes.columns, notes.columns.index(front)

    def load(text: str | None) -> dict | None:
        try:
            tree = None if not text else json.loads(text) if text.lstrip().startswith("{") else yaml.read(text)
        except (ValueError, RecursionError):
            return None
        return tree if isinstance(tree, dict) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [load(t) for t in batch.column(at).to_pylist()]
            found = pa.array([relations_of(t, relations) for t in trees], pa.list_(PARSED))
            props = pa.array([json.dumps(properties_of(t, relations), ensure_ascii=False) for t in trees], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found, props], [*columns, "front_relations", "properties_json"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.schema.fields)
    return notes.mapInArrow(run, f"{schema}, front_relations {PARSED_TYPE}, properties_json string")
