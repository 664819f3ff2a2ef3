"""The store: Parquet snapshots of nodes and edges behind a CURRENT pointer; ndjson in and out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import EDGE, NODE, Batch, as_edges, as_nodes
from ..functions.text import prefixes
from ..operators import mutate


class Store:
    """``<path>/snapshot=<n>/{nodes,edges}`` and ``<path>/CURRENT``; readers see a snapshot whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        """Number of the snapshot that readers see; 0 for none."""
        if not self._fs.exists(self._at(f"{self.path}/CURRENT")):
            return 0
        return int(self.spark.read.text(f"{self.path}/CURRENT").first().value)

    def _read(self, what: str, schema) -> DataFrame:
        n = self.current()
        if not n:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/snapshot={n}/{what}")

    def nodes(self) -> DataFrame:
        return self._read("nodes", NODE)

    def edges(self) -> DataFrame:
        return self._read("edges", EDGE)

    def write(self, nodes: DataFrame, edges: DataFrame) -> int:
        """A new snapshot; the pointer moves by a rename when both tables are there. Returns its number."""
        n = self.current() + 1
        while self._fs.exists(self._at(f"{self.path}/.claim-{n}")):
            n += 1
        # Of two writers that want one number the second fails here, before it writes anything.
        self._fs.create(self._at(f"{self.path}/.claim-{n}"), False).close()
        as_nodes(nodes).select(*NODE.names).write.parquet(f"{self.path}/snapshot={n}/nodes")
        as_edges(edges).select(*EDGE.names).write.parquet(f"{self.path}/snapshot={n}/edges")
        self.put("CURRENT", str(n))
        return n

    def put(self, name: str, content: str) -> None:
        """A small file beside the snapshots, replaced by one rename: readers see the old one or the new one."""
        new, target = self._at(f"{self.path}/.{name}-{uuid.uuid4().hex}"), self._at(f"{self.path}/{name}")
        out = self._fs.create(new, True)
        out.write(bytearray(content.encode()))
        out.close()
        sc = self.spark.sparkContext
        mode = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        modes = sc._gateway.new_array(mode, 1)
        modes[0] = mode.OVERWRITE
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(target), modes)

    def get(self, name: str) -> str:
        """Content of such a file; empty if there is none."""
        if not self._fs.exists(self._at(f"{self.path}/{name}")):
            return ""
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first().value

    def _records(self, name: str, key: str, row: dict | None = None, gone: Iterable[str] = ()) -> list[dict]:
        rows = {r[key]: r for r in json.loads(self.get(name) or "[]")}
        if row is None and not gone:
            return list(rows.values())
        if row:
            rows[row[key]] = row
        kept = [rows[k] for k in sorted(rows) if k not in set(gone)]
        self.put(name, json.dumps(kept, indent=2) + "\n")
        return kept

    def sources(self) -> list[dict]:
        """What was gathered: a row per path with ``head``, ``head_unix``, ``added_unix``, ``tree_sig``."""
        return self._records("source.json", "path")

    def record_source(self, path: str, head: str = "", head_unix: int = 0, added_unix: int = 0, tree_sig: str = "") -> None:
        self._records("source.json", "path", {"path": path, "head": head, "head_unix": head_unix, "added_unix": added_unix, "tree_sig": tree_sig})

    def stamps(self) -> dict[str, int]:
        """When each source was captured last, by id."""
        return {r["id"]: r["captured_unix"] for r in self._records("sources.json", "id")}

    def record_stamp(self, id_: str, captured_unix: int) -> None:
        self._records("sources.json", "id", {"id": id_, "captured_unix": captured_unix})

    def remove_stamps(self, ids: Iterable[str]) -> None:
        self._records("sources.json", "id", gone=tuple(ids))

    def lanes(self, path: str, head: str, tree_sig: str, force: bool = False) -> set[str]:
        """What has to be gathered anew: nothing if the tree is as it was, no history if the head is.

        A path without a record, and one recorded without a signature or head, is gathered whole.
        """
        known = next((r for r in self.sources() if r["path"] == path), None)
        if not force and known and tree_sig and known["tree_sig"] == tree_sig:
            return set()
        if not force and known and head and known["head"] == head:
            return {"files"}
        return {"files", "history"}

    def merge(self, batch: Batch) -> int:
        return self.write(*mutate.merge(self.nodes(), self.edges(), batch))

    def replace(self, batch: Batch, force: bool = False) -> mutate.Replaced:
        done = mutate.replace(self.nodes(), self.edges(), batch, force)
        self.write(done.nodes, done.edges)
        return done

    def prune_orphans(self, declared: DataFrame) -> list[str]:
        """Empty forced replacements of the producers ``source:*`` that are no longer declared."""
        gone = [r.producer for r in mutate.orphans(self.nodes(), declared).collect()]
        for name in gone:
            empty = Batch(name, self.spark.createDataFrame([], NODE), self.spark.createDataFrame([], EDGE))
            self.replace(empty, force=True)
        return gone

    def manifest(self) -> DataFrame:
        """``path``, ``sha256``, ``size`` of every file of the current snapshot."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/snapshot={self.current()}")
        return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def read_ndjson(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON; the first bad one fails the read."""
    n = spark.read.schema(NODE).option("mode", "FAILFAST").json(nodes_path)
    e = spark.read.schema(EDGE).option("mode", "FAILFAST").json(edges_path)
    return as_nodes(n), as_edges(e)


def read_batch(spark: SparkSession, path: str) -> Batch:
    """One JSON document ``{"producer", "nodes", "edges"}``."""
    from pyspark.sql import types as T

    shape = T.StructType([T.StructField("producer", T.StringType()), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE))])
    doc = spark.read.schema(shape).option("mode", "FAILFAST").json(path, multiLine=True)
    name = doc.select("producer").first().producer
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    edges = doc.select(F.explode("edges").alias("e")).select("e.*")
    return Batch(name or "", as_nodes(nodes), as_edges(edges))


@dataclass(frozen=True)
class Fingerprint:
    sha256: str
    files: int


def tree_signature(spark: SparkSession, path: str) -> Fingerprint:
    """Digest of sorted (path, time, size) lines; equal signatures mean nothing to do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    line = F.concat_ws("\u0000", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string"))
    r = files.select(line.alias("l")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("l")), "\n"), 256).alias("s"), F.count("*").alias("n")).first()
    return Fingerprint(r.s, r.n)


# Folders in a tree of stores that hold no stores.
NO_STORES = ("graph", "wiki", "cards", "hooks", "memory", "reflections", "grammars", "toolchain")
LISTING_DEPTH = 12


def stores_below(spark: SparkSession, root: str) -> list[str]:
    """Keys (paths below ``root``) of the stores in a tree of at most ``LISTING_DEPTH`` levels; folders of stores' parts are skipped."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], [("", 0)]
    while todo:
        key, depth = todo.pop()
        here = f"{root.rstrip('/')}/{key}".rstrip("/")
        if key and fs.exists(path(f"{here}/CURRENT")):
            found.append(key)
        if depth >= LISTING_DEPTH or not fs.exists(path(here)):
            continue
        for s in fs.listStatus(path(here)):
            name = s.getPath().getName()
            if s.isDirectory() and name not in NO_STORES and not name.startswith((".", "snapshot=")):
                todo.append((f"{key}/{name}".strip("/"), depth + 1))
    return sorted(found)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``key``, ``root`` (first part of the key), ``nodes``, ``edges`` of every store below a folder."""
    parts = [Store(spark, f"{root.rstrip('/')}/{k}") for k in stores_below(spark, root)]
    rows = [(s.path.removeprefix(root.rstrip("/")).strip("/"), s.nodes().count(), s.edges().count()) for s in parts]
    return spark.createDataFrame([(k, k.split("/")[0], n, e) for k, n, e in rows], "key string, root string, nodes long, edges long").orderBy("key")


def orphan_stores(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Stores of ``found(key)`` that ``declared(key)`` has not; of nested ones only the outermost."""
    gone = found.select("key").join(declared.select("key"), "key", "left_anti")
    inside = gone.select("key", F.explode(prefixes("key", "/")).alias("outer")).where("outer <> key")
    nested = inside.join(gone.select(F.col("key").alias("outer")), "outer", "left_semi").select("key")
    return gone.join(nested, "key", "left_anti").orderBy("key")


def missing_stores(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared stores that are not there or have no node: what a partial gather has to fill."""
    return declared.select("key").join(found.where("nodes > 0").select("key"), "key", "left_anti").orderBy("key")
