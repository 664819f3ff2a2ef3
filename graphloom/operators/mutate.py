"""Validation, quarantine, and changes of the two tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions.schema import CONFIDENCE, EDGE_KEY, Batch, owned, producer, stamped


class Rejected(ValueError):
    pass


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def node_fault() -> Column:
    out = F.when(F.lit(False), "")
    for name in ("id", "label", "kind", "file_type", "source"):
        out = out.when(_blank(name), f"{name} is required")
    return out


def edge_fault() -> Column:
    out = F.when(F.lit(False), "")
    for name in ("source", "target", "relation"):
        out = out.when(_blank(name), f"{name} is required")
    return out.when(~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False)), "confidence is unknown")


def validate(batch: Batch) -> None:
    """Whole batch or nothing: raises on a blank producer, any fault, or a repeated id."""
    if not batch.producer.strip():
        raise Rejected("producer is required")
    for df, fault in ((batch.nodes, node_fault()), (batch.edges, edge_fault())):
        bad = df.select(fault.alias("f")).where("f is not null").first()
        if bad:
            raise Rejected(bad.f)
    twice = batch.nodes.groupBy("id").count().where("count > 1").first()
    if twice:
        raise Rejected(f"duplicate id {twice.id!r}")


@dataclass
class Parts:
    nodes: DataFrame
    edges: DataFrame
    quarantine: DataFrame


def partition(batch: Batch, order: str | None = None) -> Parts:
    """Good rows, and ``quarantine(id, reason)``. Of repeated ids the first by ``order`` stays (by position without one).

    An edge goes with an endpoint that was found invalid here; endpoints that are
    elsewhere, or only repeated, don't matter.
    """
    tagged = batch.nodes.withColumn("at", F.col(order) if order else F.monotonically_increasing_id()).withColumn("fault", node_fault())
    tagged = tagged.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at")))
    tagged = tagged.withColumn("reason", F.coalesce("fault", F.when(F.col("n") > 1, "duplicate id in batch")))
    good = tagged.where("reason is null")
    bad_ids = tagged.where("fault is not null").select("id").distinct().join(good.select("id"), "id", "left_anti")
    e = batch.edges.withColumn("fault", edge_fault())
    sound = e.where("fault is null")
    lost_s = sound.join(bad_ids.withColumnRenamed("id", "source"), "source", "left_semi")
    lost_t = sound.join(bad_ids.withColumnRenamed("id", "source"), "source", "left_anti").join(bad_ids.withColumnRenamed("id", "target"), "target", "left_semi")
    kept = sound.join(bad_ids.withColumnRenamed("id", "source"), "source", "left_anti").join(bad_ids.withColumnRenamed("id", "target"), "target", "left_anti")
    arrow = F.concat(F.coalesce("source", F.lit("")), F.lit("->"), F.coalesce("target", F.lit("")))
    dangling = lost_s.unionByName(lost_t).select(arrow.alias("id"), F.lit("dangling: endpoint quarantined this batch").alias("reason"))
    faults = tagged.where("reason is not null").select(F.coalesce("id", F.lit("")).alias("id"), "reason")
    faults = faults.unionByName(e.where("fault is not null").select(arrow.alias("id"), F.col("fault").alias("reason")))
    return Parts(good.select(*batch.nodes.columns), kept.select(*batch.edges.columns), faults.unionByName(dangling))


def last_by_key(df: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """Of rows with one key the last by ``order``."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return df.withColumn("__n", place).where("__n = 1").drop("__n", order)


def _last_edges(edges: DataFrame) -> DataFrame:
    return last_by_key(edges.withColumn("__at", F.monotonically_increasing_id()), EDGE_KEY, "__at")


def new_rows(nodes: DataFrame, edges: DataFrame, batch: Batch) -> tuple[int, int]:
    """How many nodes and edges of a batch the store doesn't have yet."""
    n = batch.nodes.select("id").distinct().join(nodes.select("id"), "id", "left_anti").count()
    return n, batch.edges.select(*EDGE_KEY).distinct().join(edges.select(*EDGE_KEY), list(EDGE_KEY), "left_anti").count()


def _upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...], keep_owner: bool) -> DataFrame:
    if keep_owner:
        # One join: a row that both have is the new one with the old one's producer.
        pair = lambda df, name: df.select(*key, F.struct(*[F.col(c) for c in old.columns]).alias(name))
        both = pair(old, "__old").join(pair(new, "__new"), list(key), "full")
        row = F.when(F.col("__new").isNull(), F.col("__old")).otherwise(F.col("__new"))
        joined = both.select(row.alias("row"), F.col("__old.metadata").getItem("producer").alias("__owner"), F.col("__new").isNotNull().alias("__is_new")).select("row.*", "__owner", "__is_new")
        owner = F.when(F.coalesce("__owner", F.lit("")) != "", F.col("__owner")).otherwise(producer())
        return joined.withColumn("metadata", F.when(F.col("__is_new"), owned(owner)).otherwise(F.col("metadata"))).select(*old.columns)
    rest = old.join(new.select(*key), list(key), "left_anti").select(*old.columns)
    return rest.unionByName(new.select(*old.columns))


def merge(nodes: DataFrame, edges: DataFrame, batch: Batch, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """Upsert: a node is replaced whole by its id, an edge by (source, target, relation), the last of a batch; existing rows keep their producer."""
    if check:
        validate(batch)
    new_nodes, new_edges = stamped(batch.nodes, batch.producer), stamped(batch.edges, batch.producer)
    return _upsert(nodes, new_nodes, ("id",), True), _upsert(edges, _last_edges(new_edges), EDGE_KEY, True)


@dataclass
class Replaced:
    nodes: DataFrame
    edges: DataFrame
    quarantine: DataFrame
    added: int
    pruned: int


def replace(nodes: DataFrame, edges: DataFrame, batch: Batch, force: bool = False) -> Replaced:
    """A producer's rows are restated: what it no longer emits goes, its edges are dropped and written anew.

    Refuses a batch of which over 5 % of the nodes are quarantined, and, unless forced,
    one with less than half the nodes the producer had. A node of another producer that
    is emitted here changes hands.
    """
    parts = partition(batch)
    total = batch.nodes.count()
    lost = total - parts.nodes.count()
    if total and lost > L.QUARANTINE_RATIO * total:
        raise Rejected(f"{lost} of {total} nodes are faulty")
    mine = producer() == batch.producer
    previous = nodes.where(mine)
    had, has = previous.count(), total - lost
    if not force and had and has * L.SHRINK_FACTOR < had:
        raise Rejected(f"{has} nodes where there were {had}")
    new_nodes = stamped(parts.nodes, batch.producer).select(*nodes.columns)
    new_edges = _last_edges(stamped(parts.edges, batch.producer).select(*edges.columns))
    pruned = previous.join(new_nodes.select("id"), "id", "left_anti").count()
    added = new_nodes.join(nodes.select("id"), "id", "left_anti").count()
    return Replaced(
        _upsert(nodes.where(~mine), new_nodes, ("id",), False), _upsert(edges.where(~mine), new_edges, EDGE_KEY, False), parts.quarantine, added, pruned
    )


def merge_stores(stores: list[tuple[str, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Stores merged in order: the last one's row of a key stays, the first one's producer with it."""

    def all_of(i: int, key: tuple[str, ...]) -> DataFrame:
        tagged = [stamped(s[i], F.when(producer() != "", producer()).otherwise(F.lit(f"merge:{s[0]}"))).withColumn("__n", F.lit(n)) for n, s in enumerate(stores)]
        out = tagged[0]
        for t in tagged[1:]:
            out = out.unionByName(t)
        by = Window.partitionBy(*key)
        owner = F.first(producer()).over(by.orderBy("__n"))
        last = out.withColumn("__owner", owner).withColumn("__k", F.row_number().over(by.orderBy(F.desc("__n"))))
        return stamped(last.where("__k = 1"), F.col("__owner")).drop("__n", "__k", "__owner")

    return all_of(1, ("id",)), all_of(2, EDGE_KEY)


def prefixed(nodes: DataFrame, edges: DataFrame, module: str | Column, mode: str = "paths") -> tuple[DataFrame, DataFrame]:
    """Ids under ``<module>/``. ``all``: every id; ``paths``: ids that look like URIs or shared names stay global."""
    m = F.lit(module) if isinstance(module, str) else module
    shared = r"^([a-z0-9+.-]+://|dep:|image:|undeclared:)"

    def under(c: Column) -> Column:
        path = F.concat(m, F.lit("/"), c)
        return path if mode == "all" else F.when(c.rlike(shared), c).otherwise(path)

    source = F.when(F.contains("source", F.lit("://")) | (F.col("source") == ""), F.col("source")).otherwise(F.concat(m, F.lit("/"), "source"))
    n = nodes.withColumns({"id": under(F.col("id")), "source": source, "module": m})
    e = edges.withColumns({"source": under(F.col("source")), "target": under(F.col("target")), "module": m})
    return n, e


def federate(modules: list[tuple[str, DataFrame, DataFrame]], root: tuple[DataFrame, DataFrame] | None = None, mode: str = "paths") -> tuple[DataFrame, DataFrame]:
    """Union of modules with prefixed ids, the root's rows first and as they are; nothing is deduplicated."""
    parts = [prefixed(n, e, name, mode) for name, n, e in modules]
    if root:
        parts.insert(0, tuple(df.withColumn("module", F.lit("")) for df in root))
    nodes, edges = parts[0]
    for n, e in parts[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes, edges


def orphans(nodes: DataFrame, declared: DataFrame) -> DataFrame:
    """Producers ``source:*`` of the store that are not in ``declared(producer)``."""
    return nodes.select(producer().alias("producer")).where("producer like 'source:%'").distinct().join(declared, "producer", "left_anti")
