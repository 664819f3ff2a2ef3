"""Flat view of the indented subset of YAML: one entry a line, with its dotted place."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

_KEY = re.compile(r"""(?:"([^"]*)"|'([^']*)'|([^\s#:][^:]*?))\s*:(?:\s+(.*))?$""")


class Line(NamedTuple):
    number: int
    path: tuple[str, ...]
    value: str


def _scalar(text: str | None) -> str:
    text = (text or "").strip()
    if text[:1] in "\"'" and len(text) > 1 and text[-1] == text[0]:
        return text[1:-1]
    return re.sub(r"\s+#.*$", "", text)


def lines(text: str, first: int = 1) -> Iterator[Line]:
    """Keys and list items (numbered in their list). No tabs, anchors or flow maps; block texts are skipped."""
    stack: list[tuple[int, str]] = []
    counts: dict[tuple[str, ...], int] = {}
    block = None
    for number, raw in enumerate(text.split("\n"), first):
        body = raw.strip()
        indent = len(raw) - len(raw.lstrip(" "))
        if block is not None and (not body or indent > block):
            continue
        block = None
        if not body or body.startswith("#") or body in ("---", "..."):
            continue
        while body == "-" or body.startswith("- "):
            while stack and (stack[-1][0] > indent or stack[-1][0] == indent and stack[-1][1].startswith("[")):
                stack.pop()
            at = tuple(s for _, s in stack)
            n = counts[at] = counts.get(at, -1) + 1
            stack.append((indent, f"[{n}]"))
            rest = body[1:].lstrip()
            indent += len(body) - len(rest)
            body = rest
            if not body:
                break
            if not _KEY.match(body):
                yield Line(number, tuple(s for _, s in stack), _scalar(body))
                body = ""
                break
        if not body or not (m := _KEY.match(body)):
            continue
        while stack and stack[-1][0] >= indent:
            stack.pop()
        stack.append((indent, next(g for g in m.groups()[:3] if g is not None)))
        value = (m[4] or "").strip()
        if re.fullmatch(r"[|>][+-]?\d*", value):
            block, value = indent, ""
        yield Line(number, tuple(s for _, s in stack), _scalar(value))


def _each_line(text: str) -> Iterator[str]:
    """The lines one by one: a list of them takes several times the text."""
    at = 0
    while (end := text.find("\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def documents(text: str) -> Iterator[list[Line]]:
    """The lines of each document of a file cut at ``---``."""
    start, part = 1, []
    for number, raw in enumerate(itertools.chain(_each_line(text), ("---",)), 1):
        if raw.rstrip() == "---":
            if found := list(lines("\n".join(part), start)):
                yield found
            start, part = number + 1, []
        else:
            part.append(raw)


def get(found: list[Line], *path: str) -> str:
    return next((x.value for x in found if x.path == path), "")


def mapping(found: list[Line], *path: str) -> dict[str, str]:
    return {x.path[-1]: x.value for x in found if x.path[:-1] == path and not x.path[-1].startswith("[")}
