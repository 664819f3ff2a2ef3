"""Communities by modularity, one graph per module, each in one task; labels spread for graphs too large for that."""

from __future__ import annotations

import heapq
from array import array
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions import text
from ..functions.tables import cut

@dataclass
class Graph:
    """Neighbours and weights of each node, row after row, in arrays: objects would take many times as much."""

    ptr: array
    near: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def row(self, i: int) -> tuple[list[int], list[float]]:
        at = slice(self.ptr[i], self.ptr[i + 1])
        return self.near[at].tolist(), self.weight[at].tolist()


def _graph(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> Graph:
    """Pairs, each for both of its ends; weights add up in the order of the pairs, and a row's neighbours are in that order."""
    keep = np.ones(2 * len(a), bool)
    keep[1::2] = a != b
    key = np.stack((a * n + b, b * n + a), axis=1).ravel()[keep]
    key, first, at = np.unique(key, return_index=True, return_inverse=True)
    weight = np.bincount(at, np.repeat(w, 2)[keep], len(key))
    rows = key // n if n else key
    order = np.lexsort((first, rows))
    ptr = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n))))
    return Graph(array("q", ptr.astype(np.int64).tobytes()), (key % n if n else key)[order], weight[order])


def _moves(graph: Graph) -> np.ndarray:
    """One level: nodes in turn go to the neighbouring community with the largest gain; ties go to the smaller number."""
    n = len(graph)
    rows = np.repeat(np.arange(n), np.diff(np.array(graph.ptr)))
    loops = dict(zip(rows[at := np.flatnonzero(rows == graph.near)].tolist(), graph.weight[at].tolist()))
    del rows
    strength = array("d", (sum(graph.row(i)[1]) + loops.get(i, 0.0) for i in range(n)))
    total = sum(strength)
    own, weight = array("q", range(n)), array("d", strength)
    for _ in range(L.ROUNDS):
        moved = False
        for i in range(n):
            if not strength[i] or not (graph.ptr[i + 1] - graph.ptr[i] - (i in loops)):
                continue
            here = own[i]
            weight[here] -= strength[i]
            to: dict[int, float] = defaultdict(float)
            to[here] = 0.0
            for j, w in zip(*graph.row(i)):
                if j != i:
                    to[own[j]] += w
            gain = lambda c: to[c] - weight[c] * strength[i] / total  # noqa: B023, E731
            best = min(to, key=lambda c: (-gain(c), c))
            if gain(best) <= gain(here) and best > here:
                best = here
            own[i] = best
            weight[best] += strength[i]
            moved |= best != here
        if not moved:
            break
    return np.array(own)


def _coarser(graph: Graph, own: np.ndarray) -> tuple[Graph, np.ndarray]:
    """A node per community, numbered by its smallest member; inner weight becomes a loop."""
    _, first, at = np.unique(own, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    new = number[at]
    rows = np.repeat(np.arange(len(graph)), np.diff(np.array(graph.ptr)))
    half = rows <= graph.near
    return _graph(len(first), new[rows[half]], new[graph.near[half]], graph.weight[half]), new


def partition(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Community number by node for ``n`` nodes; small ones join their strongest neighbour, lone small ones are left out (-1)."""
    apart = a != b
    base = level = _graph(n, a[apart], b[apart], w[apart])
    own = np.arange(n)
    for _ in range(L.LEVELS):
        smaller, number = _coarser(level, _moves(level))
        own = number[own]
        if len(smaller) == len(level):
            break
        level = smaller
    own[np.diff(np.array(base.ptr)) == 0] = -1
    sizes = dict(zip(*(x.tolist() for x in np.unique(own[own >= 0], return_counts=True))))
    few = np.array([c for c, size in sizes.items() if size < L.MIN_COMMUNITY], np.int64)
    members: dict[int, set[int]] = defaultdict(set)
    for i in np.flatnonzero(np.isin(own, few)).tolist():
        members[int(own[i])].add(i)
    heap, alone = [(len(ids), c) for c, ids in members.items()], set()
    heapq.heapify(heap)
    while heap and len(sizes) > 1 and len(alone) < len(sizes):
        size, c = heapq.heappop(heap)
        if sizes.get(c) != size or c in alone:
            continue
        pull: dict[int, float] = defaultdict(float)
        for i in members[c]:
            for j, x in zip(*base.row(i)):
                if own[j] != c:
                    pull[int(own[j])] += x
        if not pull:
            alone.add(c)
            continue
        to = min(pull, key=lambda k: (-pull[k], k))
        gone = members.pop(c)
        own[list(gone)] = to
        sizes[to] += sizes.pop(c)
        if to in members:
            members[to] |= gone
            if sizes[to] < L.MIN_COMMUNITY:
                heapq.heappush(heap, (sizes[to], to))
    for c in alone:
        own[list(members[c])] = -1
    return own


def communities(nodes: DataFrame, edges: DataFrame, module: str | None = None, method: str = "modularity") -> DataFrame:
    """``module``, ``community`` (label), ``size``, ``members``, ``hubs``, ``dirs``; largest first.

    Weights of 0 or less count as 1; loops and edges to missing nodes are left out,
    parallel edges add up. ``modularity`` works through a module's nodes in the order
    of ids, so it is one task per module; ``lpa`` spreads smallest labels over
    distributed tables and gives connected components, for modules beyond a task.
    """
    key = F.col(module) if module else F.lit("")
    own = nodes.select(key.alias("module"), "id", "label", "kind", text.parent_dir("source").alias("dir"))
    ends = own.select("module", "id")
    w = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    e = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), w.alias("w"))
    e = e.groupBy("a", "b").agg(F.sum("w").alias("w"))
    e = e.join(ends.withColumnRenamed("id", "a"), "a").join(ends.withColumnRenamed("id", "b"), ["module", "b"])
    if method == "lpa":
        named = _spread(own, e)
    else:

        def kernel(t: pa.Table) -> pa.Table:
            a, b = (t[c].cast(pa.large_string()) for c in "ab")
            ids = pc.unique(pa.chunked_array([*a.chunks, *b.chunks]))
            ids = ids.take(pc.sort_indices(ids))
            at = [pc.index_in(c, value_set=ids).to_numpy().astype(np.int64) for c in (a, b)]
            w = t["w"].to_numpy()
            order = np.lexsort((w, at[1], at[0]))
            c = partition(len(ids), at[0][order], at[1][order], w[order])
            kept = pa.array(c >= 0)
            named = ids.filter(kept).cast(pa.string())
            return pa.table([pa.array([t["module"][0].as_py()] * len(named), pa.string()), named, pa.array(c[c >= 0])], ["module", "id", "c"])

        named = e.select("module", "a", "b", "w").groupBy("module").applyInArrow(kernel, "module string, id string, c long")
    # A node's degree is its summed weight inside the graph.
    ends_of = lambda c: e.select("module", F.col(c).alias("id"), "w")
    strength = ends_of("a").unionByName(ends_of("b")).groupBy("module", "id").agg(F.sum("w").alias("degree"))
    ranked = named.join(own, ["module", "id"]).join(strength, ["module", "id"])
    return _described(ranked)


def _spread(own: DataFrame, e: DataFrame) -> DataFrame:
    """The smallest id reached, until nothing changes."""
    both = cut(e.select("module", "a", "b").unionByName(e.select("module", F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(both.select("module", F.col("a").alias("id"), F.col("a").alias("c")).distinct())
    while True:
        seen = both.join(label.withColumnRenamed("id", "b"), ["module", "b"]).groupBy("module", "a").agg(F.min("c").alias("m"))
        later = label.join(seen.withColumnRenamed("a", "id"), ["module", "id"])
        later = cut(later.select("module", "id", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
        label = later.drop("moved")
        if not later.where("moved").limit(1).count():
            return label


def _described(ranked: DataFrame) -> DataFrame:
    group = Window.partitionBy("module", "c")
    place = F.row_number().over(group.orderBy((F.col("kind") == "module").cast("int"), F.desc("degree"), "id"))
    by_degree = F.row_number().over(group.orderBy(F.desc("degree"), "id"))
    r = ranked.withColumn("first", place).withColumn("n", by_degree)
    dirs = ranked.where("dir <> ''").groupBy("module", "c", "dir").count()
    order = F.row_number().over(group.orderBy(F.desc("count"), "dir"))
    dirs = dirs.withColumn("n", order).where(F.col("n") <= L.COMMUNITY_DIRS)
    dirs = dirs.groupBy("module", "c").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "dir"))), lambda x: x["dir"]).alias("dirs"))
    out = r.groupBy("module", "c").agg(
        F.count("*").alias("size"),
        F.sort_array(F.collect_list("id")).alias("members"),
        F.max(F.when(F.col("first") == 1, F.col("label"))).alias("label"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("n") <= L.COMMUNITY_HUBS, F.struct("n", "id")))), lambda x: x["id"]).alias("hubs"),
    )
    out = out.join(dirs, ["module", "c"], "left").withColumn("dirs", F.coalesce("dirs", F.array().cast("array<string>")))
    top = F.try_element_at("dirs", F.lit(1))
    label = F.when(top.isNotNull(), F.concat("label", F.lit(" ("), top, F.lit(")"))).otherwise(F.col("label"))
    out = out.withColumn("community", label).drop("label", "c")
    return out.orderBy("module", F.desc("size"), "community", F.element_at("members", 1))
