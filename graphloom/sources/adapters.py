"""Adapters: functions, or commands that print a batch as JSON, whose rows replace what they gave before."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..functions.schema import EDGE, NODE, Batch, as_edges, as_nodes
from ..operators.mutate import Replaced
from .store import Store

_ADAPTERS: dict[str, Callable[[SparkSession], Batch]] = {}


class AdapterError(RuntimeError):
    pass


def register_adapter(name: str) -> Callable[[Callable[[SparkSession], Batch]], Callable[[SparkSession], Batch]]:
    if not name.strip():
        raise AdapterError("an adapter needs a name")

    def put(f: Callable[[SparkSession], Batch]) -> Callable[[SparkSession], Batch]:
        _ADAPTERS[name] = f
        return f

    return put


def batch_of(spark: SparkSession, name: str, text: str) -> Batch:
    """The batch that a JSON text ``{"producer", "nodes", "edges"}`` describes; the adapter's name if it names no producer."""
    try:
        doc = json.loads(text)
        rows = lambda key, shape: [tuple(r.get(c) for c in shape.names) for r in doc.get(key) or []]
        nodes, edges = rows("nodes", NODE), rows("edges", EDGE)
    except (ValueError, AttributeError) as e:
        raise AdapterError(f"{name}: the output is not a batch: {e}") from e
    return Batch(doc.get("producer") or name, as_nodes(spark.createDataFrame(nodes, NODE)), as_edges(spark.createDataFrame(edges, EDGE)))


def command(spark: SparkSession, name: str, run: str, folder: str, seconds: float = 600) -> Batch:
    """The batch that a shell command, run on the driver in ``folder``, prints."""
    if not name or not run:
        raise AdapterError("an adapter needs a name and a command")
    done = subprocess.run(["sh", "-c", run], cwd=folder, capture_output=True, text=True, timeout=seconds)
    if done.returncode:
        raise AdapterError(f"{name}: exit code {done.returncode}: {done.stderr.strip()}")
    return batch_of(spark, name, done.stdout)


def run_adapters(store: Store, only: str | None = None) -> dict[str, Replaced]:
    """Each registered adapter in the order of names (or only one); its rows replace those of its producer."""
    if only and only not in _ADAPTERS:
        raise AdapterError(f"no adapter {only!r}")
    return {n: store.replace(_ADAPTERS[n](store.spark)) for n in sorted(_ADAPTERS) if only in (None, n)}
