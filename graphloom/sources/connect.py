"""Sources by URL: which connector, variables, credentials, times to live; OpenAPI documents."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql import SparkSession

from ..functions import limits as L
from ..functions.schema import EDGE, NODE, Batch, as_edges, as_nodes
from . import catalog

Capture = Callable[[SparkSession, str], Batch]
_CONNECTORS: dict[str, Capture] = {}
# Parameters that carry credentials, and schemes of each connector.
CREDENTIALS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "user", "username")
SCHEMES = {"postgres": "postgres", "postgresql": "postgres", "mysql": "mysql", "sqlserver": "mssql", "mssql": "mssql", "mongodb": "mongodb", "mongodb+srv": "mongodb", "redis": "redis", "rediss": "redis", "kafka": "kafka", "nats": "nats", "s3": "s3", "http": "openapi", "https": "openapi", "spark": "catalog"}


class SourceError(ValueError):
    pass


def register_connector(name: str) -> Callable[[Capture], Capture]:
    def put(f: Capture) -> Capture:
        _CONNECTORS[name] = f
        return f

    return put


def expand(text: str, env: dict[str, str] | None = None) -> str:
    """``$NAME`` and ``${NAME}`` replaced, or a bare upper-case NAME as a whole; missing ones are an error."""
    env = os.environ if env is None else env
    if re.fullmatch(r"[A-Z][A-Z0-9_]*", text):
        text = "$" + text
    names = re.findall(r"\$\{?([A-Za-z_][A-Za-z0-9_]*)\}?", text)
    if missing := [n for n in names if n not in env]:
        raise SourceError(f"not set: {', '.join(dict.fromkeys(missing))}")
    return re.sub(r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*)\}|([A-Za-z_][A-Za-z0-9_]*))", lambda m: env[m[1] or m[2]], text)


def refuse_literal_credentials(text: str) -> None:
    """A declared source may name variables, not hold secrets."""
    parts = urlsplit(text)
    if parts.password and "$" not in parts.password:
        raise SourceError("a password is written in the source; use a variable")
    for k, v in parse_qsl(parts.query):
        if k.lower() in CREDENTIALS and v and "$" not in v:
            raise SourceError(f"{k} is written in the source; use a variable")


def sanitized(url: str) -> str:
    """Without user info and credential parameters; http URLs lose the whole query."""
    p = urlsplit(url)
    query = "" if p.scheme in ("http", "https") else urlencode([(k, v) for k, v in parse_qsl(p.query) if k.lower() not in CREDENTIALS])
    return urlunsplit((p.scheme, p.netloc.rpartition("@")[2], p.path, query, ""))


def connector(value: str) -> str:
    """By scheme; without one it is a file, read as OpenAPI."""
    if value in _CONNECTORS:
        return value
    scheme = urlsplit(value.removeprefix("jdbc:")).scheme
    if not scheme:
        return "openapi"
    if scheme not in SCHEMES:
        raise SourceError(f"no connector for {scheme}://")
    return SCHEMES[scheme]


def source_id(value: str) -> str:
    """The variable's name, or the sanitised address as a key."""
    if m := re.fullmatch(r"\$?\{?([A-Z][A-Z0-9_]*)\}?", value):
        return m[1]
    return re.sub(r"[^A-Za-z0-9._-]+", "-", sanitized(value)).strip("-.")


@dataclass
class Outcome:
    id: str
    status: str
    batch: Batch | None = None
    error: str = ""


def run(spark: SparkSession, declared: list[str], stamps: dict[str, int], now: int, mode: str = "ttl", ttl: int = L.SOURCE_TTL_SECONDS, env: dict[str, str] | None = None) -> list[Outcome]:
    """Capture the sources that are due, side by side; the caller merges batches in order and stamps what it merged."""

    def one(value: str) -> Outcome:
        id_ = source_id(value)
        if mode == "never" or mode == "ttl" and now - stamps.get(id_, -ttl) < ttl:
            return Outcome(id_, "skipped")
        try:
            refuse_literal_credentials(value)
            address = expand(value, env)
            name = connector(address)
            if name not in _CONNECTORS:
                raise SourceError(f"no driver for {name} is registered")
            batch = _CONNECTORS[name](spark, address)
        except Exception as e:  # a source that fails is an outcome; the others go on
            return Outcome(id_, "failed", error=sanitize_text(str(e)))
        return Outcome(id_, "captured", Batch(f"source:{id_}", batch.nodes, batch.edges))

    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(one, declared))


def strict(outcomes: list[Outcome]) -> None:
    if bad := [o for o in outcomes if o.status == "failed"]:
        raise SourceError("; ".join(f"{o.id}: {o.error}" for o in bad))


def sanitize_text(text: str) -> str:
    return re.sub(r"(?i)([a-z][a-z0-9+.-]*://)[^/\s@]*@", r"\1", text)


@register_connector("openapi")
def openapi(spark: SparkSession, address: str) -> Batch:
    """An OpenAPI 3 or Swagger 2 JSON document: api, paths, operations, schemas, security schemes, ``uses`` by $ref."""
    text = "\n".join(r.value for r in spark.read.option("wholetext", True).text(address.removeprefix("file://")).collect())
    return openapi_batch(spark, json.loads(text), sanitized(address))


def openapi_batch(spark: SparkSession, doc: dict, uri: str) -> Batch:
    if not (str(doc.get("openapi", "")).startswith("3") or str(doc.get("swagger", "")) == "2.0"):
        raise SourceError("neither OpenAPI 3 nor Swagger 2")
    nodes, edges = [], []

    def put(id_: str, label: str, kind: str, parent: str | None, **meta: str) -> str:
        nodes.append((id_, label, kind, "api", uri, "", "", {k: v for k, v in meta.items() if v}))
        if parent:
            edges.append((parent, id_, "contains", "EXTRACTED", 0.0, {}))
        return id_

    def refs(x) -> set[str]:
        if isinstance(x, dict):
            own = {x["$ref"].rpartition("/")[2]} if isinstance(x.get("$ref"), str) else set()
            return own.union(*map(refs, x.values()))
        return set().union(*map(refs, x)) if isinstance(x, list) else set()

    info = doc.get("info", {})
    api = put(uri, info.get("title") or uri, "api", None, version=str(info.get("version", "")))
    parts = doc.get("components") or {}
    schemas = parts.get("schemas") or doc.get("definitions") or {}
    for name in sorted(schemas):
        put(f"{uri}#schema/{name}", name, "schema", api)
    for name, s in sorted((parts.get("securitySchemes") or doc.get("securityDefinitions") or {}).items()):
        put(f"{uri}#security/{name}", name, "securityScheme", api, type=str(s.get("type", "")), scheme=str(s.get("scheme", "")), **{"in": str(s.get("in", ""))})
    uses = [(f"{uri}#schema/{n}", r) for n, s in schemas.items() for r in refs(s)]
    for at, item in sorted((doc.get("paths") or {}).items()):
        path = put(f"{uri}#path{at}", at, "path", api)
        for verb, op in sorted(item.items()):
            if verb.lower() in ("get", "put", "post", "delete", "patch", "head", "options", "trace"):
                id_ = put(f"{uri}#op/{verb.upper()} {at}", f"{verb.upper()} {at}", "operation", path, operation_id=str(op.get("operationId", "")), summary=str(op.get("summary", "")))
                uses += [(id_, r) for r in refs(op)]
    edges += [(a, f"{uri}#schema/{r}", "uses", "EXTRACTED", 0.0, {}) for a, r in sorted(set(uses)) if r in schemas]
    return Batch("source:openapi", as_nodes(spark.createDataFrame(nodes, NODE)), as_edges(spark.createDataFrame(edges, EDGE)))


def _jdbc(spark: SparkSession, address: str) -> Batch:
    return catalog.capture_jdbc(spark, address if address.startswith("jdbc:") else f"jdbc:{address}")


for _name in ("postgres", "mysql", "mssql"):
    _CONNECTORS[_name] = _jdbc


@register_connector("s3")
def prefixes(spark: SparkSession, address: str, depth: int = 2, most: int = 500) -> Batch:
    """Bucket and its prefixes of at most two levels with key counts, from file paths; nothing is read."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(address).select("path")
    base = sanitized(address).rstrip("/")
    key = F.regexp_replace("path", "^.*?" + re.escape(base.rpartition("/")[2]) + "/", "")
    folders = F.split(key, "/")
    each = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda i: F.when(F.size(folders) > i, F.array_join(F.slice(folders, F.lit(1), i), "/")))).alias("p")).where("p is not null")
    top = each.groupBy("p").agg(F.count("*").alias("n")).orderBy("p").limit(most)
    kinds = top.select(F.concat(F.lit(base + "/"), "p").alias("id"), F.col("p").alias("label"), F.lit("prefix").alias("kind"), F.create_map(F.lit("key_count"), F.col("n").cast("string")).alias("metadata"))
    bucket = spark.createDataFrame([(base, base.rpartition("/")[2], "bucket")], "id string, label string, kind string")
    nodes = [as_nodes(x.withColumns({"file_type": F.lit("storage"), "source": F.lit(base)})) for x in (bucket, kinds)]
    parent = F.when(F.contains("p", F.lit("/")), F.concat(F.lit(base + "/"), F.substring_index("p", "/", 1))).otherwise(F.lit(base))
    edges = top.select(parent.alias("source"), F.concat(F.lit(base + "/"), "p").alias("target"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"))
    return Batch("source:s3", nodes[0].unionByName(nodes[1]), as_edges(edges))


def sampled_fields(rows: list[dict], most: int = 64) -> list[str]:
    """``name (type/type)`` of the fields of sampled documents."""
    types: dict[str, set[str]] = {}
    for r in rows:
        for k, v in r.items():
            types.setdefault(k, set()).add(type(v).__name__)
    return [f"{k} ({'|'.join(sorted(t))})" for k, t in sorted(types.items())[:most]]


def key_prefixes(keys: list[tuple[str, str]]) -> dict[str, tuple[int, str]]:
    """Of sampled (key, type): count and an example type by prefix."""
    out: dict[str, tuple[int, str]] = {}
    for k, t in keys:
        p = k.partition(":")[0]
        out[p] = (out.get(p, (0, t))[0] + 1, out.get(p, (0, t))[1])
    return out
