"""Files to nodes and edges: documents, manifests, Kubernetes, Python sources.

Parsers are plain generators over one file, run inside ``mapInArrow``; what concerns
several files (calls, selectors) is joined afterwards. More can be registered.
"""

from __future__ import annotations

import ast
import contextlib
import itertools
import json
import pickle
import posixpath
import re
import tempfile
import xml.etree.ElementTree as ET
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions import text as X
from ..functions.schema import EDGE, NODE, Batch, as_edges, as_nodes
from ..functions.tables import cut
from ..operators import links
from ..operators.mutate import last_by_key
from . import yaml_lines as Y

Row = dict
Parser = Callable[[str, str], Iterator[Row]]
_PARSERS: list[tuple[re.Pattern, str, Parser]] = []


def register_parser(pattern: str, producer: str = "custom") -> Callable[[Parser], Parser]:
    """Run a parser on files whose path matches ``pattern``; its rows go to ``producer``."""

    def put(f: Parser) -> Parser:
        _PARSERS.append((re.compile(pattern), producer, f))
        return f

    return put


def node(id_: str, label: str, kind: str, file_type: str, source: str, location: str = "", **metadata: str) -> Row:
    return {"row": "node", "id": id_, "label": label, "kind": kind, "file_type": file_type, "source": source, "location": location, "metadata": {k: v for k, v in metadata.items() if v}}


def edge(source: str, target: str, relation: str, confidence: str = "EXTRACTED", **metadata: str) -> Row:
    return {"row": "edge", "source": source, "target": target, "relation": relation, "confidence": confidence, "metadata": {k: v for k, v in metadata.items() if v}}


# Folders and files that are never read.
PRUNED = ("node_modules", "vendor", "target", "dist", "build")
CODE = r"(?i)\.(py|go|java|js|jsx|mjs|cjs|ts|tsx|c|h|cc|cpp|hpp|cs|rs|rb|php|kt|swift|sql)$"
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "Cargo.lock", "poetry.lock", "composer.lock", "Gemfile.lock", "packages.lock.json")


def read_files(spark: SparkSession, root: str, ignored: DataFrame | None = None) -> DataFrame:
    """``path`` (below root), ``content`` of the text files worth reading; ``ignored(path)`` lists files or folders to skip."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    files = raw.select(F.replace(at, F.lit(base), F.lit("")).alias("path"), "length", "content")
    folders = "|".join(map(re.escape, PRUNED))
    files = files.where(~F.col("path").rlike(rf"(^|/)(\.[^/]+|{folders}|[^/]*-out)/") & (F.col("length") <= L.CODE_BYTES))
    code = F.col("path").rlike(CODE)
    files = files.where((code | ~X.is_secret_name("path")) & ~F.substring_index("path", "/", -1).isin(*LOCKFILES))
    if ignored is not None:
        inside = files.select("path", F.explode(X.prefixes("path", "/")).alias("prefix"))
        files = files.join(inside.join(ignored.select(F.col("path").alias("prefix")), "prefix").select("path"), "path", "left_anti")
    files = files.select("path", F.col("content").cast("string").alias("content"))
    longest = F.array_max(F.transform(F.split("content", "\n"), F.octet_length))
    return files.where(~F.col("path").rlike(CODE) | (longest <= L.MINIFIED_LINE))


def _slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def _numbered(used: dict[str, int], name: str) -> str:
    used[name] = used.get(name, 0) + 1
    return name if used[name] == 1 else f"{name}-{used[name]}"


# --- Documents


@register_parser(r"\.(md|markdown)$", "markdown")
def markdown(path: str, text: str) -> Iterator[Row]:
    """Sections nested by heading level, each reaching to the next heading of its level or above; links from them."""
    yield node(path, posixpath.basename(path), "document", "document", path, "L1")
    rows = text.split("\n")
    heads = [(i, len(m[1]), m[2]) for i, x in enumerate(rows, 1) if (m := re.match(r"(#{1,6})\s+(.+?)\s*$", x))]
    used: dict[str, int] = {}
    ids = [f"{path}::{_numbered(used, _slug(t))}" for _, _, t in heads]
    # Sections that a heading is inside of, outermost first: each heading comes and goes once.
    ends, parents, inside = [len(rows)] * len(heads), [path] * len(heads), []
    for k, (at, level, _) in enumerate(heads):
        while inside and heads[inside[-1]][1] >= level:
            ends[inside.pop()] = at - 1
        if inside:
            parents[k] = ids[inside[-1]]
        inside.append(k)
    for k, (at, _, title) in enumerate(heads):
        yield node(ids[k], title, "section", "document", path, f"L{at}-L{ends[k]}")
        yield edge(parents[k], ids[k], "contains")
    k = -1
    for at, line in enumerate(rows, 1):
        while k + 1 < len(heads) and heads[k + 1][0] <= at:
            k += 1
        here = ids[k] if k >= 0 else path
        for name in re.findall(r"\[\[([^\]]+)\]\]", line):
            yield edge(here, name.strip(), "references", "INFERRED")
        for to in re.findall(r"\]\(([^)#]+\.md)[^)]*\)", line):
            if "://" not in to:
                yield edge(here, posixpath.normpath(posixpath.join(posixpath.dirname(path), to)), "references")


# Files whose keys are listed, by ending or by name.
CONFIG = r"(?i:\.(properties|ya?ml|toml|ini))$"
MANIFESTS = (
    "package.json", "pom.xml", "go.mod", "go.work", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts",
    "Cargo.toml", "pyproject.toml", "Makefile", "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "Taskfile.yml", "Taskfile.yaml",
)


@register_parser(CONFIG + "|(^|/)(" + "|".join(map(re.escape, MANIFESTS)) + ")$", "markdown")
def config_keys(path: str, text: str) -> Iterator[Row]:
    """A node of the file and one of each plain key; none for files named like secrets."""
    name = posixpath.basename(path)
    if len(text.encode()) > L.CONFIG_BYTES or re.search(r"secret|credential|password|^\.env", name.lower()):
        return
    yield node(path, name, "config", "config", path, "L1")
    used: dict[str, int] = {}
    for at, raw in enumerate(text.split("\n"), 1):
        line = raw.rstrip(" \t\r")
        if not line or line.lstrip().startswith(("#", "//")) or line != raw and line[0] in " \t":
            continue
        section = line.startswith("[") and line.endswith("]")
        mark = re.search("[:=]", line)
        key = line.strip("[]") if section else line[: mark.start()].strip() if mark else ""
        if not key or len(key.encode()) > 80 or re.search("[{}\"' ]", key) or not (slug := _slug(key)):
            continue
        id_ = f"{path}#{_numbered(used, slug)}"
        yield node(id_, key, "config_key", "config", path, f"L{at}")
        yield edge(path, id_, "contains")


def summary_of(readme: str, size: int = 120) -> str:
    """The first heading, else the first plain line, of a page; comments, notes and licence headers are skipped."""
    plain, hidden = "", False
    for line in map(str.strip, readme.split("\n")):
        if hidden or line.startswith("<!--"):
            hidden = "-->" not in line
        elif line.startswith("#"):
            if head := line.lstrip("#").strip():
                return head[:size]
        elif not plain and line and not line.startswith(("[!", "Licensed to", "license")):
            plain = line
    return plain[:size]


METHODS = ("get", "put", "post", "delete", "patch", "head", "options", "trace")


@register_parser(r"\.ya?ml$", "markdown")
def yaml_routes(path: str, text: str) -> Iterator[Row]:
    """OpenAPI paths, routing files (a ``path`` beside a ``_controller``), Ingress rules."""
    if not any(word in text for word in ("openapi", "swagger", "Ingress", "_controller", "_form")):
        return
    for found in Y.documents(text):
        routes = []
        if Y.get(found, "openapi") or Y.get(found, "swagger"):
            routes = [(x.path[2].upper(), x.path[1], x.number, "") for x in found if len(x.path) == 3 and x.path[0] == "paths" and x.path[2].lower() in METHODS]
        elif Y.get(found, "kind") == "Ingress":
            routes = [("ANY", x.value, x.number, "") for x in found if x.path[-1] == "path" and "paths" in x.path and x.value]
        else:
            for x in found:
                if len(x.path) == 2 and x.path[1] == "path" and x.value.startswith("/"):
                    handler = Y.get(found, x.path[0], "defaults", "_controller") or Y.get(found, x.path[0], "defaults", "_form")
                    if handler:
                        verbs = [y.value.upper() for y in found if y.path[:2] == (x.path[0], "methods") and y.value and not y.value.startswith("[")]
                        routes += [(v, x.value, x.number, handler) for v in verbs or ["ANY"]]
        for method, at, number, handler in routes:
            id_ = f"{path}::route:{method} {at}"
            yield node(id_, f"{method} {at}", "route", "document", path, f"L{number}", method=method, path=at, handler=handler)
            yield edge(path, id_, "contains")


# --- Manifests


def _dependency(path: str, ecosystem: str, name: str, version: str = "", scope: str = "") -> Iterator[Row]:
    id_ = f"dep:{ecosystem}/{name}"
    known = {raw: label for label, raws in X.SCOPES.items() for raw in raws}
    label = known.get(scope) or ("test" if scope.lower().startswith("test") else "")
    yield node(id_, name, "dependency", "manifest", f"dep://{ecosystem}/{name}", ecosystem=ecosystem)
    yield edge(path, id_, "declares", version_spec=version, scope=scope, scope_class=label)


def _manifest(path: str) -> Row:
    return node(path, posixpath.basename(path), "config", "manifest", path, "L1")


def _task(path: str, tool: str, name: str, line: int = 0, command: str = "") -> Iterator[Row]:
    id_ = f"{path}::task:{name}"
    yield node(id_, f"{tool}:{name}", "task", "manifest", path, f"L{line}" if line else "", command=command[:160])
    yield edge(path, id_, "contains")


@register_parser(r"(^|/)package\.json$", "manifests")
def npm(path: str, text: str) -> Iterator[Row]:
    doc = json.loads(text)
    yield _manifest(path)
    for section in ("dependencies", "devDependencies", "peerDependencies"):
        for name, version in sorted((doc.get(section) or {}).items()):
            yield from _dependency(path, "npm", name, str(version), section)
    for name, command in sorted((doc.get("scripts") or {}).items()):
        yield from _task(path, "npm", name, 0, str(command))
    spaces = doc.get("workspaces") or []
    for place in spaces.get("packages", []) if isinstance(spaces, dict) else spaces:
        yield edge(path, posixpath.normpath(posixpath.join(posixpath.dirname(path), place, "package.json")), "depends_on")


def _xml(text: str) -> ET.Element:
    root = ET.fromstring(text)
    for x in root.iter():
        x.tag = x.tag.rpartition("}")[2]
    return root


@register_parser(r"(^|/)pom\.xml$", "manifests")
def maven(path: str, text: str) -> Iterator[Row]:
    root = _xml(text)
    yield _manifest(path)
    found = [(x, x.findtext("scope") or "compile") for x in root.findall("dependencies/dependency")]
    found += [(x, "plugin") for x in root.findall("build/plugins/plugin")] + [(x, "parent") for x in root.findall("parent")]
    for x, scope in found:
        group, name = x.findtext("groupId", "").strip(), x.findtext("artifactId", "").strip()
        if name:
            yield from _dependency(path, "maven", f"{group}:{name}" if group else name, x.findtext("version", "").strip(), scope)
    for m in root.findall("modules/module"):
        yield edge(path, posixpath.normpath(posixpath.join(posixpath.dirname(path), (m.text or "").strip(), "pom.xml")), "depends_on")


@register_parser(r"\.gradle(\.kts)?$", "manifests")
def gradle(path: str, text: str) -> Iterator[Row]:
    yield _manifest(path)
    for line in text.split("\n"):
        m = re.match(r"(implementation|api|testImplementation|runtimeOnly|compileOnly)\s*\(?\s*(['\"])([^'\"$({]+)\2\s*\)?\s*$", line.strip())
        if m and len(parts := m[3].split(":")) == 3 and all(parts):
            yield from _dependency(path, "maven", ":".join(parts[:2]), parts[2], m[1])


@register_parser(r"(^|/)go\.mod$", "manifests")
def go_mod(path: str, text: str) -> Iterator[Row]:
    yield _manifest(path)
    inside = False
    for line in text.split("\n"):
        body, _, note = line.strip().partition("//")
        words = body.split()
        if words[:2] == ["require", "("]:
            inside = True
        elif body.strip() == ")":
            inside = False
        elif len(words) == 3 and words[0] == "require" or inside and len(words) == 2:
            yield from _dependency(path, "go", words[-2], words[-1], "indirect" if note.strip() == "indirect" else "require")


@register_parser(r"\.csproj$", "manifests")
def csproj(path: str, text: str) -> Iterator[Row]:
    root = _xml(text)
    yield _manifest(path)
    for x in root.iter("PackageReference"):
        if name := x.get("Include"):
            yield from _dependency(path, "nuget", name, x.get("Version") or x.findtext("Version", ""), "package")
    for x in root.iter("ProjectReference"):
        if to := x.get("Include"):
            yield edge(path, posixpath.join(posixpath.dirname(path), to.replace("\\", "/")), "depends_on")


@register_parser(r"\.sln$", "manifests")
def solution(path: str, text: str) -> Iterator[Row]:
    yield _manifest(path)
    for to in re.findall(r'(?m)^Project\("\{[^}]+\}"\)\s*=\s*"[^"]*",\s*"([^"]+)"', text):
        if to.endswith("proj"):
            yield edge(path, posixpath.join(posixpath.dirname(path), to.replace("\\", "/")), "contains")


@register_parser(r"(^|/)([Mm]akefile|Taskfile\.ya?ml|[Jj]ustfile)$", "manifests")
def tasks(path: str, text: str) -> Iterator[Row]:
    name = posixpath.basename(path).lower()
    if name.startswith("taskfile"):
        for x in Y.lines(text):
            if len(x.path) == 2 and x.path[0] == "tasks":
                yield from _task(path, "task", x.path[1], x.number)
        return
    tool = "make" if name == "makefile" else "just"
    pattern = r"([A-Za-z0-9][A-Za-z0-9_.-]*)\s*:(?!=)" if tool == "make" else r"@?([A-Za-z0-9][A-Za-z0-9_-]*)(?:\s+[^:=]*)?:(?!=)"
    seen = set()
    for at, line in enumerate(text.split("\n"), 1):
        if (m := re.match(pattern, line)) and m[1] not in seen:
            seen.add(m[1])
            yield from _task(path, tool, m[1], at)


# Kinds that run pods.
WORKLOADS = ("deployment", "statefulset", "daemonset", "job", "cronjob", "pod", "replicaset")


@register_parser(r"\.ya?ml$", "manifests")
def kubernetes(path: str, text: str) -> Iterator[Row]:
    """Resources with kind, apiVersion and name; templates and the data of secrets are not read."""
    if "{{" in text:
        return
    for found in Y.documents(text):
        kind, name = Y.get(found, "kind"), Y.get(found, "metadata", "name")
        if not (kind and name and Y.get(found, "apiVersion")):
            continue
        ns, lower = Y.get(found, "metadata", "namespace") or "default", kind.lower()
        id_ = f"k8s://{ns}/{lower}/{name}"
        pod = ("spec", "jobTemplate", "spec", "template") if lower == "cronjob" else () if lower == "pod" else ("spec", "template")
        labels = Y.mapping(found, *pod, "metadata", "labels") if lower in WORKLOADS else {}
        selector = Y.mapping(found, "spec", "selector") if lower == "service" else {}
        more = {f"label.{k}": v for k, v in labels.items()} | {f"selector.{k}": v for k, v in selector.items()}
        yield node(id_, f"{lower}/{name}", "resource", "manifest", path, f"L{found[0].number}", k8s_kind=kind, namespace=ns, **more)
        yield edge(path, id_, "contains")
        for x in found:
            tail = x.path[-2:]
            if lower in WORKLOADS and x.path[-1] == "image" and x.value:
                yield node(f"image:{x.value}", x.value, "image", "manifest", f"image:{x.value}")
                yield edge(id_, f"image:{x.value}", "uses_image")
            elif lower == "ingress" and x.value and (tail == ("service", "name") or x.path[-1] == "serviceName"):
                yield edge(id_, f"k8s://{ns}/service/{x.value}", "routes_to")
            elif lower in WORKLOADS and x.value:
                for refs, to in ((("configMap", "name"), "configmap"), (("configMapRef", "name"), "configmap"), (("configMapKeyRef", "name"), "configmap"), (("secret", "secretName"), "secret"), (("secretRef", "name"), "secret"), (("secretKeyRef", "name"), "secret"), (("persistentVolumeClaim", "claimName"), "persistentvolumeclaim")):
                    if tail == refs:
                        yield edge(id_, f"k8s://{ns}/{to}/{x.value}", "mounts")


# --- Python sources


def python_parts(text: str) -> list[tuple[int, str]]:
    """A Python file cut between statements into parts of some thousand lines, each with the number of lines before it.

    A part is cut at a line that can only begin a statement. If what is before it can be
    parsed on its own, no string, bracket or decorator is open there, so the statements
    of the parts are those of the file; else the part goes on. Raises as parsing the
    file would.
    """
    lines = re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)
    borders = [i for i, x in enumerate(lines) if re.match(r"(?!(?:else|elif|except|finally)\b)[A-Za-z_@]", x)]
    out, first, size = [], 0, PYTHON_LINES
    while first < len(lines):
        k = bisect_left(borders, first + size)
        last = borders[k] if k < len(borders) else len(lines)
        part = "".join(lines[first:last])
        try:
            ast.parse(part)
        except (SyntaxError, ValueError):
            if last == len(lines):
                raise
            size *= 2
            continue
        out.append((first, part))
        first, size = last, PYTHON_LINES
    return out


@register_parser(r"\.py$", "code")
def python_source(path: str, text: str) -> Iterator[Row]:
    """Declarations with signature and doc, imports, call sites (rows ``call``) and literal routes of decorators."""
    yield node(path, posixpath.basename(path), "file", "code", path)
    try:
        parts = python_parts(text)
    except (SyntaxError, ValueError):
        return
    before, source = 0, []

    def target(call: ast.expr) -> str:
        return call.attr if isinstance(call, ast.Attribute) else call.id if isinstance(call, ast.Name) else ""

    def walk(body: ast.AST, outer: tuple[str, ...], owner: str, in_class: bool) -> Iterator[Row]:
        for x in ast.iter_child_nodes(body):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = (*outer, x.name)
                id_ = f"{path}::{'.'.join(name)}"
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if in_class else "function"
                line = source[x.lineno - 1].strip().rstrip(":")
                doc = (ast.get_docstring(x) or "")[: L.DOC_CHARS]
                yield node(id_, ".".join(name), kind, "code", path, f"L{before + x.lineno}-L{before + x.end_lineno}", signature=line[: L.SIGNATURE_CHARS], doc=doc)
                yield edge(owner, id_, "contains")
                yield from routes(x, id_)
                yield from walk(x, name, id_, isinstance(x, ast.ClassDef))
                continue
            if isinstance(x, ast.Import | ast.ImportFrom):
                names = [a.name for a in x.names] if isinstance(x, ast.Import) else ["." * x.level + (x.module or "")]
                for spec in names:
                    if spec.strip(".") and len(spec) <= L.IMPORT_CHARS:
                        yield node(f"module://{spec}", spec, "module", "code", f"module://{spec}")
                        yield edge(path, f"module://{spec}", "imports")
            elif isinstance(x, ast.Call) and (name := target(x.func)):
                yield {"row": "call", "source": owner, "target": name, "metadata": {"file": path}}
            yield from walk(x, outer, owner, in_class)

    def routes(f: ast.AST, id_: str) -> Iterator[Row]:
        for d in getattr(f, "decorator_list", []):
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str)):
                continue
            verb, at = d.func.attr.lower(), d.args[0].value
            if verb in METHODS and at.startswith("/"):
                verbs = [verb.upper()]
            elif verb == "route":
                given = next((k.value for k in d.keywords if k.arg == "methods"), None)
                verbs = [e.value.upper() for e in given.elts if isinstance(e, ast.Constant)] if isinstance(given, ast.List | ast.Tuple) else ["GET"]
            else:
                continue
            for v in verbs:
                route = f"{path}::route:{v} {at}"
                yield node(route, f"{v} {at}", "route", "code", path, f"L{before + d.lineno}", method=v, path=at)
                yield edge(path, route, "contains")
                yield edge(route, id_, "handles", "INFERRED")

    for before, part in parts:
        source = re.split(r"\r\n|\r|\n", part)
        yield from walk(ast.parse(part), (), path, False)


# --- Running


_SHAPE = "row string, producer string, id string, label string, kind string, file_type string, source string, location string, target string, relation string, confidence string, metadata map<string,string>"


#: Rows that a worker holds at once, of a parser and of what it hands on; lines of a Python file that are parsed at once, at least.
HELD_ROWS, PYTHON_LINES = 2_000, 2_000
_FIELDS = [(c.split()[0], pa.map_(pa.string(), pa.string()) if "map<" in c else pa.string()) for c in _SHAPE.split(", ")]


def whole(found: Iterator[Row]) -> Iterator[Row]:
    """The rows of a parser once it has come to its end; all but a few wait in a temporary file."""
    with contextlib.ExitStack() as stack:
        held, file, parts = [], None, 0
        for r in found:
            held.append(r)
            if len(held) >= HELD_ROWS:
                file = file or stack.enter_context(tempfile.TemporaryFile())
                pickle.dump(held, file, pickle.HIGHEST_PROTOCOL)
                held, parts = [], parts + 1
        if file:
            file.seek(0)
        for _ in range(parts):
            yield from pickle.load(file)
        yield from held


def rows(files: DataFrame) -> DataFrame:
    """Rows of all parsers on ``files(path, content)``; a file that a parser can't read gives it no rows.

    A worker holds one file's content beside the batch that it is in, and a bounded number of rows.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for batch in batches:
            for path, content in zip(*batch.columns):
                path, content = path.as_py(), content.as_py()
                for pattern, producer, parser in _PARSERS:
                    if not pattern.search(path):
                        continue
                    try:
                        for r in whole(parser(path, content or "")):
                            known = r.get("metadata")
                            yield {**r, "producer": producer, "metadata": None if known is None else [*known.items()]}
                    except (ValueError, ET.ParseError, RecursionError):
                        continue

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = found(batches)
        while out := [*itertools.islice(each, HELD_ROWS)]:
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], kind) for n, kind in _FIELDS], [n for n, _ in _FIELDS])

    # Parsing takes far longer than moving the texts, which in few partitions would be few tasks.
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "content").repartition(parts, "path").mapInArrow(run, _SHAPE)


def batches(files: DataFrame) -> list[Batch]:
    """One batch per producer, calls and selectors resolved; within a producer the first row of an id stays, the last of an edge."""
    found = cut(rows(files))
    nodes = as_nodes(found.where("row = 'node'").select(*[c for c in NODE.names if c != "scope"], "producer"))
    edges = as_edges(found.where("row = 'edge'").select(*[c for c in EDGE.names if c != "weight"], "producer"))
    calls = found.where("row = 'call'").select(F.col("source").alias("caller"), F.col("metadata")["file"].alias("file"), F.col("target").alias("name"))
    decls = nodes.where("file_type = 'code' and kind in ('function', 'method', 'class')")
    named = decls.select("id", F.col("source").alias("file"), F.substring_index("label", ".", -1).alias("name"))
    made = links.resolve_calls(calls, named).select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit("code").alias("producer"))
    pick = lambda p: F.transform_keys(F.map_filter("metadata", lambda k, v: k.startswith(p)), lambda k, v: F.substr(k, F.lit(len(p) + 1)))
    res = nodes.where("kind = 'resource'").withColumn("namespace", F.col("metadata")["namespace"])
    services = res.select("id", "namespace", pick("selector.").alias("selector"))
    work = res.select("id", "namespace", pick("label.").alias("labels"))
    chosen = links.select_workloads(services, work).select(F.col("service").alias("source"), F.col("workload").alias("target"), F.lit("selects").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit("manifests").alias("producer"))
    edges = edges.unionByName(as_edges(made).select(*edges.columns)).unionByName(as_edges(chosen).select(*edges.columns))
    out = []
    for name in ("markdown", "code", "manifests", *sorted({p for _, p, _ in _PARSERS} - {"markdown", "code", "manifests"})):
        n = nodes.where(F.col("producer") == name).drop("producer").dropDuplicates(["id"])
        mine = edges.where(F.col("producer") == name).drop("producer").withColumn("at", F.monotonically_increasing_id())
        e = last_by_key(mine, ("source", "target", "relation"), "at")
        out.append(Batch(name, n, e))
    return out


def dependency_links(nodes: DataFrame, edges: DataFrame, own: DataFrame) -> DataFrame:
    """``resolves_to`` edges from imported modules to declared dependencies; ``own(path)`` are the modules' own import paths."""
    imports = edges.where("relation = 'imports'").select(F.col("source").alias("file"), F.col("target").alias("module_id"))
    specs = imports.select("module_id", F.replace("module_id", F.lit("module://"), F.lit("")).alias("spec")).distinct()
    deps = nodes.where("kind = 'dependency'").select(F.col("id").alias("dep_id"), F.col("metadata")["ecosystem"].alias("ecosystem"), F.col("label").alias("name"))
    met = links.resolve_imports(specs, deps, own)
    return as_edges(met.select(F.col("module_id").alias("source"), F.col("dep_id").alias("target"), F.lit("resolves_to").alias("relation"), F.lit("INFERRED").alias("confidence")))


def scan_modules(files: DataFrame, markers: tuple[str, ...] = ("go.mod", "package.json", "pom.xml", "build.gradle", "Cargo.toml", "pyproject.toml"), depth: int = L.SCAN_DEPTH) -> DataFrame:
    """``dir``, ``marker``: folders of at most ``depth`` levels that hold a marker file."""
    name = F.substring_index("path", "/", -1)
    found = files.where(name.isin(*markers) | name.rlike(r"\.(csproj|sln)$")).select(X.parent_dir("path").alias("dir"), name.alias("name"))
    shallow = found.where((F.col("dir") == "") | (F.size(F.split("dir", "/")) <= depth))
    return shallow.groupBy("dir").agg(F.min("name").alias("marker")).orderBy("dir")
