"""Walks over edges: level by level, each level one join, visited ids kept out by an anti join.

A level's frontier carries its place in the order of a first-in-first-out walk. Levels
are checkpointed to the shared folder, so plans stay short and survive lost executors.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions.tables import cut, small


class NoPath(LookupError):
    pass


def _numbered(level: DataFrame, *order: str) -> DataFrame:
    """Place in the level. Ranges of the order are numbered side by side, each from where those before it end."""
    spark = level.sparkSession
    dealt = cut(level.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    before, sizes = 0, []
    for r in dealt.groupBy("range").count().orderBy("range").collect():
        sizes.append((r.range, before))
        before += r["count"]
    if len(sizes) < 2:
        return dealt.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*order))).drop("range")
    # One row per range.
    begins = F.broadcast(spark.createDataFrame(sizes, "range int, begin long"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("n", own).join(begins, "range").withColumn("place", (F.col("n") + F.col("begin")).cast("int")).drop("range", "n", "begin")


def _start(edges: DataFrame, node: str) -> DataFrame:
    return edges.sparkSession.createDataFrame([(node, 1)], "id string, place int")


def affected(nodes: DataFrame, edges: DataFrame, target: str, depth: int = L.AFFECTED_DEPTH, relations: tuple[str, ...] = (), symmetric: tuple[str, ...] = ()) -> DataFrame:
    """What depends on ``target``, walking edges backwards: node fields, ``depth``, ``via``, ``depends_on``, ``place``.

    Each node once, at its least depth, by the first edge that reaches it; ordered by
    depth and place. The target itself is not listed, ids without a node are, with empty
    fields. Relations given in ``symmetric`` are walked both ways.
    """
    e = edges.where(F.col("relation").isin(*relations)) if relations else edges
    e = e.select("source", "target", "relation")
    if symmetric:
        back = e.where(F.col("relation").isin(*symmetric)).select(F.col("target").alias("source"), F.col("source").alias("target"), "relation")
        e = e.unionByName(back)
    frontier, seen, levels = _start(e, target), _start(e, target).select("id"), []
    size = known = 1
    for d in range(1, depth + 1):
        near = e.join(small(frontier.select(F.col("id").alias("target"), F.col("place").alias("from_place")), size), "target")
        new = near.join(small(seen.withColumnRenamed("id", "source"), known), "source", "left_anti")
        first = F.min(F.struct("from_place", "relation", "target"))
        level = new.groupBy("source").agg(first.alias("m"))
        level = level.select(F.col("source").alias("id"), F.col("m.relation").alias("via"), F.col("m.target").alias("depends_on"), F.col("m.from_place").alias("from_place"))
        level = cut(_numbered(level, "from_place", "id").withColumn("depth", F.lit(d)))
        size = level.count()
        if not size:
            break
        known += size
        levels.append(level)
        seen = cut(seen.unionByName(level.select("id")))
        frontier = level.select("id", "place")
    shape = "id string, via string, depends_on string, from_place int, place int, depth int"
    found = e.sparkSession.createDataFrame([], shape)
    for level in levels:
        found = found.unionByName(level)
    fields = nodes.select("id", "label", "kind", "source")
    named = found.drop("from_place").join(fields, "id", "left").na.fill("", ["label", "kind", "source"])
    return named.select("id", "label", "kind", "source", "depth", "via", "depends_on", "place")


def depths(edges: DataFrame, start: str, depth: int, direction: str = "both") -> DataFrame:
    """``id``, ``depth`` of everything within ``depth`` edges of ``start`` (itself at 0)."""
    pairs = []
    if direction in ("out", "both"):
        pairs.append(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    if direction in ("in", "both"):
        pairs.append(edges.select(F.col("target").alias("a"), F.col("source").alias("b")))
    e = pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, depth int")
    frontier, size, known = seen.select("id"), 1, 1
    for d in range(1, depth + 1):
        next_ = e.join(small(frontier.withColumnRenamed("id", "a"), size), "a").select(F.col("b").alias("id")).distinct()
        next_ = cut(next_.join(small(seen, known), "id", "left_anti"))
        size = next_.count()
        if not size:
            break
        known += size
        seen = cut(seen.unionByName(next_.withColumn("depth", F.lit(d))))
        frontier = next_
    return seen


@dataclass(frozen=True)
class Step:
    source: str
    target: str
    relation: str
    direction: str


class _Front:
    """One end of a walk: the ids reached last and before, and the edges from each level to the next."""

    def __init__(self, edges: DataFrame, node: str):
        self.edges, self.size, self.known = edges, 1, 1
        self.ids = self.seen = _start(edges, node).select("id")
        self.levels: list[DataFrame] = []

    def go_on(self) -> bool:
        """One level farther; false where there is nothing new."""
        near = self.edges.join(small(self.ids.withColumnRenamed("id", "a"), self.size), "a")
        near = cut(near.join(small(self.seen.withColumnRenamed("id", "b"), self.known), "b", "left_anti").select("a", "b", "relation", "dir"))
        self.ids = cut(near.select(F.col("b").alias("id")).distinct())
        self.size = self.ids.count()
        self.known += self.size
        self.seen = self.seen.unionByName(self.ids)
        self.levels.append(near)
        return self.size > 0

    def back(self, ids: DataFrame) -> list[DataFrame]:
        """Of each level, the first one first, the edges by which a shortest walk reaches ``ids`` of the last one."""
        out = []
        for level in reversed(self.levels):
            out.append(cut(level.join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "relation", "dir")))
            ids = out[-1].select(F.col("a").alias("id")).distinct()
        return out[::-1]


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int | None = None) -> list[Step]:
    """Steps of a shortest walk, edges taken either way (``->`` or ``<-``); none if both ends are one.

    Among parents in the level before, the first in the order of the walk; among
    parallel edges the least relation, forwards before backwards.

    Both ends are walked from, the smaller front first, until they meet: that gives the
    edges of all shortest walks. All parents of a node on such a walk, in the level before,
    are on one, too, so the order of the walk among them is that among all nodes.
    """
    if start == goal:
        return []
    out = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "relation", F.lit("->").alias("dir"))
    into = edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "relation", F.lit("<-").alias("dir"))
    e = out.unionByName(into)
    fronts = _Front(e, start), _Front(e, goal)
    for _ in itertools.count() if max_depth is None else range(max_depth):
        if not min(fronts, key=lambda f: (f.size, len(f.levels))).go_on():
            break
        met = fronts[0].ids.join(fronts[1].ids, "id", "left_semi")
        if met.limit(1).count():
            turned = lambda x: x.select(F.col("b").alias("a"), F.col("a").alias("b"), "relation", F.when(F.col("dir") == "->", "<-").otherwise("->").alias("dir"))
            met = cut(met)
            return _first_walk(_start(e, start), goal, fronts[0].back(met) + [turned(x) for x in reversed(fronts[1].back(met))])
    raise NoPath(f"no path from {start!r} to {goal!r}")


def _first_walk(frontier: DataFrame, goal: str, steps: list[DataFrame]) -> list[Step]:
    """The first walk to ``goal`` along edges ``a``, ``b``, ``relation``, ``dir`` from level to level."""
    levels = []
    for near in steps:
        near = near.join(frontier.select(F.col("id").alias("a"), F.col("place").alias("from_place")), "a")
        first = F.min(F.struct("from_place", F.when(F.col("dir") == "->", 0).otherwise(1).alias("back"), "relation", "a", "dir"))
        level = near.groupBy("b").agg(first.alias("m")).select(F.col("b").alias("id"), "m.from_place", "m.a", "m.relation", "m.dir")
        levels.append(cut(_numbered(level, "from_place", "id")))
        frontier = levels[-1].select("id", "place")
    walk, at = [], goal
    for past in reversed(levels):
        r = past.where(F.col("id") == at).first()
        walk.append(Step(r.a, at, r.relation, r.dir))
        at = r.a
    return walk[::-1]


def neighborhood(nodes: DataFrame, edges: DataFrame, center: str, depth: int = 1, limit: int = L.VIEW_LIMIT) -> DataFrame:
    """Nodes within ``depth`` (3 at most) edges either way, nearest first, then by id, ``limit`` at most.

    Ids without a node are neither listed nor walked through.
    """
    ids = nodes.select("id")
    real = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    real = cut(real.select("source", "target"))
    return nodes.join(depths(real, center, min(depth, 3)), "id").orderBy("depth", "id").limit(limit)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
