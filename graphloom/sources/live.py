"""Document stores, caches, brokers: what a small client tells, as a batch. Samples are bounded and say so.

Each function takes the client, so it runs without a server; ``register`` ties those whose
driver can be imported to their scheme.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterable
from itertools import islice
from typing import Protocol

from pyspark.sql import SparkSession

from ..functions.schema import EDGE, NODE, Batch, as_edges, as_nodes
from .connect import key_prefixes, register_connector, sampled_fields, sanitized

# Bounds of samples.
SAMPLE_DOCUMENTS, SAMPLE_FIELDS, SAMPLE_KEYS = 100, 64, 5000


class _Rows:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.base, self.nodes, self.edges = spark, sanitized(uri).rstrip("/"), [], []

    def put(self, id_: str, label: str, kind: str, parent: str = "", **meta: object) -> str:
        self.nodes.append((id_, label, kind, "source", self.base, "", "", {k: str(v) for k, v in meta.items() if v not in ("", None)}))
        if parent:
            self.edges.append((parent, id_, "contains", "EXTRACTED", 0.0, {}))
        return id_

    def link(self, a: str, b: str, relation: str) -> None:
        self.edges.append((a, b, relation, "EXTRACTED", 0.0, {}))

    def batch(self, name: str) -> Batch:
        return Batch(f"source:{name}", as_nodes(self.spark.createDataFrame(self.nodes, NODE)), as_edges(self.spark.createDataFrame(self.edges, EDGE)))


class Documents(Protocol):
    def collections(self) -> Iterable[str]: ...
    def sample(self, collection: str, most: int) -> Iterable[dict]: ...


def mongodb(spark: SparkSession, uri: str, client: Documents) -> Batch:
    r = _Rows(spark, uri)
    db = r.put(r.base, r.base.rpartition("/")[2], "database")
    for name in sorted(client.collections()):
        if not name.startswith("system."):
            rows = list(islice(client.sample(name, SAMPLE_DOCUMENTS), SAMPLE_DOCUMENTS))
            r.put(f"{r.base}/{name}", name, "collection", db, fields="|".join(sampled_fields(rows, SAMPLE_FIELDS)), sampled=len(rows), sample_cap=SAMPLE_DOCUMENTS)
    return r.batch("mongodb")


class Keys(Protocol):
    def scan(self) -> Iterable[tuple[str, str]]: ...


def redis(spark: SparkSession, uri: str, client: Keys) -> Batch:
    r = _Rows(spark, uri)
    db = r.put(r.base, r.base.rpartition("/")[2] or "0", "database")
    keys = list(islice(client.scan(), SAMPLE_KEYS))
    for prefix, (n, kind) in sorted(key_prefixes(keys).items()):
        r.put(f"{r.base}/{prefix}", prefix, "key_prefix", db, approx_count=n, example_type=kind, scan_cap=SAMPLE_KEYS)
    return r.batch("redis")


class Broker(Protocol):
    def topics(self) -> Iterable[tuple[str, int, int]]: ...
    def groups(self) -> Iterable[tuple[str, list[str]]]: ...


def kafka(spark: SparkSession, uri: str, client: Broker) -> Batch:
    """Topics (name, partitions, replication) but internal ones, consumer groups with the topics they read."""
    r = _Rows(spark, uri)
    cluster = r.put(r.base, r.base.rpartition("//")[2], "cluster")
    for name, partitions, replication in sorted(client.topics()):
        if not name.startswith("_"):
            r.put(f"{r.base}/topic/{name}", name, "topic", cluster, partitions=partitions, replication=replication)
    for name, topics in sorted(client.groups()):
        group = r.put(f"{r.base}/group/{name}", name, "consumer_group", cluster)
        for t in sorted(topics):
            r.link(group, f"{r.base}/topic/{t}", "uses")
    return r.batch("kafka")


class Streams(Protocol):
    def streams(self) -> Iterable[dict]: ...


def nats(spark: SparkSession, uri: str, client: Streams) -> Batch:
    """Streams with subjects, messages and consumers; system streams are skipped, buckets say what they are."""
    r = _Rows(spark, uri)
    server = r.put(r.base, r.base.rpartition("//")[2], "server")
    for s in sorted(client.streams(), key=lambda s: s["name"]):
        if not s["name"].startswith("$SYS"):
            store = "kv" if s["name"].startswith("KV_") else "objectstore" if s["name"].startswith("OBJ_") else ""
            r.put(f"{r.base}/stream/{s['name']}", s["name"], "stream", server, subjects=",".join(s.get("subjects", [])), messages=s.get("messages", 0), consumers=s.get("consumers", 0), store=store)
    return r.batch("nats")


def register() -> list[str]:
    """Connectors whose driver is installed; returns their names."""
    found = []
    if importlib.util.find_spec("pymongo"):

        @register_connector("mongodb")
        def _(spark: SparkSession, uri: str) -> Batch:
            import pymongo

            db = pymongo.MongoClient(uri).get_default_database()

            class Client:
                collections = staticmethod(db.list_collection_names)
                sample = staticmethod(lambda name, most: db[name].find().limit(most))

            return mongodb(spark, uri, Client())

        found.append("mongodb")
    if importlib.util.find_spec("redis"):

        @register_connector("redis")
        def _(spark: SparkSession, uri: str) -> Batch:
            import redis as driver

            c = driver.Redis.from_url(uri, decode_responses=True)

            class Client:
                scan = staticmethod(lambda: ((k, c.type(k)) for k in c.scan_iter()))

            return redis(spark, uri, Client())

        found.append("redis")
    return found
