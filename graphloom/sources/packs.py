"""Rules as data: manifests read by path, routes found by call."""

from __future__ import annotations

import ast
import fnmatch
import json
import posixpath
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

from . import yaml_lines
from .extract import METHODS, Row, _dependency, _manifest, _task, edge, node, register_parser


class PackError(ValueError):
    pass


def select_path(kind: str, text: str, path: str) -> Iterator[tuple[str, str]]:
    """(name, value) at a dotted path of a JSON or YAML text (``*``: any key or item), or an element path of XML (``/@attr``)."""
    if kind == "xml":
        where, _, attribute = path.partition("/@")
        root = ET.fromstring(text)
        for x in root.iter():
            x.tag = x.tag.rpartition("}")[2]
        for x in root.findall(where.removeprefix(root.tag + "/")):
            yield (x.get(attribute) if attribute else (x.text or "").strip()) or "", x.get("version") or x.get("Version") or ""
        return
    steps = path.split(".")
    if kind == "yaml":
        for line in yaml_lines.lines(text):
            if len(line.path) == len(steps) and all(s == "*" or s == p for s, p in zip(steps, line.path)):
                listed = line.path[-1].startswith("[")
                yield (line.value, "") if listed else (line.path[-1], line.value)
        return

    def walk(x, left: list[str], name: str) -> Iterator[tuple[str, str]]:
        if not left:
            yield (name, x if isinstance(x, str) else "") if name else (str(x), "")
            return
        items = x.items() if isinstance(x, dict) else [("", v) for v in x] if isinstance(x, list) else []
        for k, v in items:
            if left[0] == "*" or left[0] == k:
                yield from walk(v, left[1:], k)

    yield from walk(json.loads(text), steps, "")


@dataclass(frozen=True)
class ManifestRule:
    name: str
    file: str
    format: str
    path: str
    emit: str
    ecosystem: str = ""
    scope: str = ""


def manifest_pack(text: str) -> list[ManifestRule]:
    """Rules of a JSON pack; registered as a parser. Anything malformed is an error, never skipped."""
    try:
        rules = [ManifestRule(**r) for r in json.loads(text)["rules"]]
    except (ValueError, KeyError, TypeError) as e:
        raise PackError(f"bad manifest pack: {e}") from None
    for r in rules:
        if r.format not in ("json", "yaml", "xml") or r.emit not in ("dependency", "task") or r.emit == "dependency" and not r.ecosystem:
            raise PackError(f"bad manifest rule {r.name!r}")

        @register_parser(fnmatch.translate(r.file).replace("(?s:", "(?s:(?:.*/)?", 1), "manifests")
        def read(path: str, text: str, r: ManifestRule = r) -> Iterator[Row]:
            yield _manifest(path)
            for name, value in select_path(r.format, text, r.path):
                if name and r.emit == "dependency":
                    yield from _dependency(path, r.ecosystem, name, value, r.scope)
                elif name:
                    yield from _task(path, r.name, name, 0, value)

    return rules


@dataclass(frozen=True)
class RouteRule:
    call: str
    path_arg: int = 0
    handler_arg: int | None = None
    method_arg: int | None = None
    method: str = "ANY"


def route_packs(*texts: str) -> dict[str, list[RouteRule]]:
    """Packs ``{"name", "routes": [..]}``; a later pack replaces an earlier one of its name. Registered for Python sources."""
    packs: dict[str, list[RouteRule]] = {}
    for text in texts:
        try:
            doc = json.loads(text)
            packs[doc["name"]] = [RouteRule(**r) for r in doc["routes"]]
        except (ValueError, KeyError, TypeError) as e:
            raise PackError(f"bad route pack: {e}") from None
    rules = [r for pack in packs.values() for r in pack]

    @register_parser(r"\.py$", "code")
    def read(path: str, text: str) -> Iterator[Row]:
        for x in ast.walk(ast.parse(text)):
            if isinstance(x, ast.Call):
                for r in rules:
                    yield from _route(path, x, r)

    return packs


def _route(path: str, call: ast.Call, rule: RouteRule) -> Iterator[Row]:
    """A route of literal arguments only."""

    def literal(i: int | None) -> str:
        a = call.args[i] if i is not None and i < len(call.args) else None
        return a.value if isinstance(a, ast.Constant) and isinstance(a.value, str) else ""

    if ast.unparse(call.func) != rule.call and not ast.unparse(call.func).endswith("." + rule.call):
        return
    at = literal(rule.path_arg)
    method = (literal(rule.method_arg) or rule.method).upper()
    if not at.startswith("/") or method != "ANY" and method.lower() not in METHODS:
        return
    id_ = f"{path}::route:{method} {at}"
    yield node(id_, f"{method} {at}", "route", "code", path, f"L{call.lineno}", method=method, path=at)
    yield edge(path, id_, "contains")
    if rule.handler_arg is not None and rule.handler_arg < len(call.args) and isinstance(h := call.args[rule.handler_arg], ast.Name):
        yield edge(id_, f"{path}::{h.id}", "handles", "INFERRED")


def expand_modules(declared: list[dict], folders: list[str]) -> list[tuple[str, list[str]]]:
    """Modules ``{"name"?, "path" or "paths"}`` with globs against the folders there are; the first that claims a folder has it."""
    out, taken = [], set()
    for m in declared:
        claimed = []
        for glob in m.get("paths") or [m["path"]]:
            found = [f for f in sorted(folders) if f not in taken and fnmatch.fnmatchcase(f, glob) and ("**" in glob or f.count("/") == glob.count("/"))]
            taken.update(found)
            claimed += found
        if "paths" in m:
            out.append((m["name"], claimed))
        else:
            out += [(m.get("name") or posixpath.basename(f), [f]) for f in claimed]
    return out


def plan_tasks(modules: list[tuple[str, list[str]]]) -> list[tuple[str, list[str], list[str]]]:
    """(module, folders, excluded folders of modules inside) and the rest of the root last, under an empty name."""
    every = [f for _, fs in modules for f in fs]
    plan = [(n, fs, [x for x in every if x not in fs and any(x.startswith(f.rstrip("/") + "/") for f in fs)]) for n, fs in modules]
    return [*plan, ("", ["."], every)]
