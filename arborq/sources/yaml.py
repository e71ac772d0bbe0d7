"""Front-matter blocks as trees: the part of YAML that note properties use.

Block maps and lists nested by indentation, one-line lists and maps, plain and quoted keys and scalars, texts over several lines
(`|` and `>`), comments. Anchors, tags and several documents are not read: such a line is a plain scalar.
"""

from __future__ import annotations

import json
import re
from typing import Any

_KEY = re.compile(r"""(?P<key>"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\[\]{},#&*!|>'"%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?=\s|$)""")
_BLOCK = re.compile(r"[|>][-+]?(\s+#.*)?")
_TEXT = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'")
_COMMENT = re.compile(r"(?:^|\s)#")
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\Z")
_CONSTANTS = {"": None, "~": None, "null": None, "true": True, "false": False}  # fixed values


def read(block: str) -> Any:
    """The tree of a block; ValueError if it isn't one."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip(), x) for x in block.replace("\t", "  ").splitlines()]
    value, at = _node(lines, _next(lines, 0), 0)
    if _next(lines, at) < len(lines):
        raise ValueError(f"line {at + 1} is out of place")
    return value


def _next(lines: list, at: int) -> int:
    while at < len(lines) and (not lines[at][1] or lines[at][1].startswith("#")):
        at += 1
    return at


def _node(lines: list, at: int, least: int) -> tuple[Any, int]:
    """The value that begins at a line, if indented by `least` at least, and the line after it."""
    if at >= len(lines) or lines[at][0] < least:
        return None, at
    indent, text, _ = lines[at]
    if text.startswith("- ") or text == "-":
        return _list(lines, at, indent)
    if _KEY.match(text):
        return _map(lines, at, indent)
    return scalar(text), at + 1


def _list(lines: list, at: int, indent: int) -> tuple[list, int]:
    out = []
    while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("- ") or lines[at][1] == "-"):
        rest = lines[at][1][1:].strip()
        if not rest or rest.startswith("#"):
            value, at = _node(lines, _next(lines, at + 1), indent + 1)
        elif rest.startswith("- ") or (_KEY.match(rest) and rest[0] not in "[{"):
            inner = indent + len(lines[at][1]) - len(rest)
            lines[at] = (inner, rest, lines[at][2])
            value, at = _node(lines, at, inner)
        else:
            value, at = _inline(lines, at, rest, indent)
        out.append(value)
        at = _next(lines, at)
    return out, at


def _map(lines: list, at: int, indent: int) -> tuple[dict, int]:
    out: dict = {}
    while at < len(lines) and lines[at][0] == indent and (m := _KEY.match(lines[at][1])):
        key, rest = str(_quoted(m["key"]) if m["key"][0] in "\"'" else m["key"]), lines[at][1][m.end() :].strip()
        if not rest or rest.startswith("#"):
            after = _next(lines, at + 1)
            same = after < len(lines) and lines[after][0] == indent and lines[after][1].startswith("-")  # lists may stand level with their key
            value, at = _node(lines, after, indent if same else indent + 1)
        else:
            value, at = _inline(lines, at, rest, indent)
        out[key] = value
        at = _next(lines, at)
    return out, at


def _inline(lines: list, at: int, rest: str, indent: int) -> tuple[Any, int]:
    """A value that begins on its key's line."""
    if rest[0] in "|>" and _BLOCK.fullmatch(rest):
        taken, at = [], at + 1
        while at < len(lines) and (not lines[at][1] or lines[at][0] > indent):
            taken.append(lines[at])
            at += 1
        while taken and not taken[-1][1]:
            taken.pop()
        margin = min((x[0] for x in taken if x[1]), default=0)
        kept = [x[2][margin:].rstrip() for x in taken]
        body = "\n".join(kept) if rest[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(kept))
        return body + ("" if rest[1:2] == "-" or not body else "\n"), at
    while rest[0] in "[{" and not _balanced(rest) and at + 1 < len(lines):
        at += 1
        rest += " " + lines[at][1]
    return scalar(rest), at + 1


def _balanced(text: str) -> bool:
    bare = _TEXT.sub("", text)
    return bare.count("[") + bare.count("{") <= bare.count("]") + bare.count("}")


def _quoted(text: str) -> str:
    return json.loads(text) if text[0] == '"' else text[1:-1].replace("''", "'")


def scalar(text: str) -> Any:
    """A one-line value: quoted or plain text, number, truth value, null, list or map."""
    value, rest = _flow(text.strip(), "")
    if rest and not rest.startswith("#"):
        raise ValueError(f"unexpected {rest!r}")
    return value


def _flow(text: str, stops: str) -> tuple[Any, str]:
    """A value at the start of a text, and what follows it."""
    if text[:1] == "[" and not text.startswith("[["):
        items, text = [], text[1:].lstrip()
        while text and text[0] != "]":
            item, text = _flow(text, ",]")
            items.append(item)
            text = text[1:].lstrip() if text[:1] == "," else text
        return items, _closed(text)
    if text[:1] == "{":
        made: dict = {}
        text = text[1:].lstrip()
        while text and text[0] != "}":
            key, text = _flow(text, ":,}")
            value, text = _flow(text[1:].lstrip(), ",}") if text[:1] == ":" else (None, text)
            made[str(key)] = value
            text = text[1:].lstrip() if text[:1] == "," else text
        return made, _closed(text)
    if text[:1] in ("'", '"'):
        m = _TEXT.match(text)
        if m is None:
            raise ValueError(f"unclosed quote in {text!r}")
        return _quoted(m[0]), text[m.end() :].lstrip()
    if text.startswith("[[") and (end := text.find("]]")) >= 0:  # a link that is not quoted is meant as one
        return text[: end + 2], text[end + 2 :].lstrip()
    end = next((i for i, c in enumerate(text) if c in stops and (c != ":" or text[i + 1 : i + 2] in ("", " "))), len(text)) if stops else len(text)
    plain = text[:end]
    plain = (_COMMENT.split(plain, maxsplit=1)[0] if "#" in plain else plain).strip()
    if plain.lower() in _CONSTANTS:
        return _CONSTANTS[plain.lower()], text[end:].lstrip()
    if _NUMBER.match(plain):
        return float(plain) if any(c in plain for c in ".eE") else int(plain), text[end:].lstrip()
    return plain, text[end:].lstrip()


def _closed(text: str) -> str:
    if not text:
        raise ValueError("unclosed list or map")
    return text[1:].lstrip()
