"""What surrounds a node: explanation, card, hubs, change plan, viewer payload."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions import text
from ..functions.tables import cut, dealt
from . import traverse


def explain(edges: DataFrame, node: str) -> DataFrame:
    """``dir``, ``relation``, ``ids`` (sorted) of the edges of a node; a loop is in both directions."""
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("dir"), "relation", F.col("target").alias("id"))
    into = edges.where(F.col("target") == node).select(F.lit("in").alias("dir"), "relation", F.col("source").alias("id"))
    return out.unionByName(into).groupBy("dir", "relation").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def card(nodes: DataFrame, edges: DataFrame, node: str, cap: int = L.LIST_CAP) -> DataFrame:
    """One row: the node's fields, ``parent``, ``contains``, ``calls``, ``called_by``, ``imports``, ``other``, ``hidden``.

    Lists have ``cap`` entries at most, in order; ``hidden`` tells how many more each has.

    Each edge lands once. The parent is the greatest source of an edge that contains the
    node; ``other`` lists "relation → id" and "relation ← id".
    """
    mine = edges.where((F.col("source") == node) | (F.col("target") == node))
    out = F.col("source") == node
    rel = F.col("relation")
    role = (
        F.when(~out & (rel == "contains"), "parent").when(out & (rel == "contains"), "contains")
        .when(out & (rel == "calls"), "calls").when(~out & (rel == "calls"), "called_by")
        .when(out & (rel == "imports"), "imports").otherwise("other")
    )
    other = F.when(out, F.concat_ws(" ", rel, F.lit("→"), "target")).otherwise(F.concat_ws(" ", rel, F.lit("←"), "source"))
    end = F.when(out, F.col("target")).otherwise(F.col("source"))
    parts = mine.select(role.alias("role"), F.when(role == "other", other).otherwise(end).alias("x"))
    lists = ("contains", "calls", "called_by", "imports", "other")
    # The first rows of a role are found in every task before its shuffle; of parents the greatest counts.
    first = F.row_number().over(Window.partitionBy("role").orderBy("x"))
    top = parts.where("role <> 'parent'").withColumn("n", first).where(F.col("n") <= cap)
    counts = parts.groupBy("role").agg(F.count("*").alias("n"), F.max("x").alias("last"))
    listed = lambda name: F.sort_array(F.collect_list(F.when(F.col("role") == name, F.col("x")))).alias(name)
    more = lambda name: F.greatest(F.coalesce(F.max(F.when(F.col("role") == name, F.col("n"))), F.lit(0)) - cap, F.lit(0)).alias(name)
    summed = top.agg(*map(listed, lists)).crossJoin(counts.agg(F.max(F.when(F.col("role") == "parent", F.col("last"))).alias("parent"), F.struct(*map(more, lists)).alias("hidden")))  # one row each
    return nodes.where(F.col("id") == node).limit(1).crossJoin(summed)  # one row each


def degrees(edges: DataFrame) -> DataFrame:
    """``id``, ``n_in``, ``n_out``; a loop counts in both."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o")))).alias("e"))
    return dealt(ends.select("e.id", "e.o"), "id").groupBy("id").agg(F.sum(1 - F.col("o")).alias("n_in"), F.sum("o").alias("n_out"))


def hubs(nodes: DataFrame, edges: DataFrame, top: int = L.HUBS) -> DataFrame:
    """Existing nodes with most edges, ties by id."""
    ranked = nodes.select("id", "label", "kind").join(degrees(edges), "id").withColumn("degree", F.col("n_in") + F.col("n_out"))
    return ranked.orderBy(F.desc("degree"), "id").limit(top)


@dataclass
class Plan:
    card: DataFrame
    impacts: DataFrame
    tests: DataFrame
    cochanges: DataFrame
    confidence: DataFrame


def change_plan(nodes: DataFrame, edges: DataFrame, node: str, depth: int = L.AFFECTED_DEPTH) -> Plan:
    """Card, and the impacts split into co-changes, tests and the rest, each capped, with ``hidden`` (how many more)."""
    hit = cut(traverse.affected(nodes, edges, node, depth))

    def capped(df: DataFrame, cap: int) -> DataFrame:
        total = df.agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("hidden"))
        return df.orderBy("depth", "place").limit(cap).crossJoin(total)  # at most cap rows and one

    together = F.col("via") == "co_changed_with"
    test = text.is_plan_test("source")
    blast = hit.select("id").unionByName(nodes.where(F.col("id") == node).select("id"))
    inside = traverse.induced(blast, edges).where("relation <> 'co_changed_with'")
    return Plan(
        card(nodes, edges, node),
        capped(hit.where(~together & ~test), L.PLAN_IMPACTS),
        capped(hit.where(~together & test), L.PLAN_TESTS),
        capped(hit.where(together), L.PLAN_COCHANGES),
        inside.groupBy("confidence").count(),
    )


def viewer_payload(nodes: DataFrame, edges: DataFrame, limit: int = L.VIEW_LIMIT, center: str | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """What a viewer shows: the nodes of highest degree, special kinds, a sample of each producer not yet there; and their edges."""
    limit = min(limit, L.VIEW_MAX)
    if center:
        shown = traverse.neighborhood(nodes, edges, center, depth, limit).drop("depth")
        return shown, traverse.induced(shown, edges)
    ranked = nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce(F.col("n_in") + F.col("n_out"), F.lit(0)))
    producer = F.coalesce(F.try_element_at("metadata", F.lit("producer")), F.lit(""))
    ranked = cut(ranked.withColumn("producer", producer).select("id", "kind", "degree", "producer"))
    top = ranked.orderBy(F.desc("degree"), "id").limit(limit)
    special = ranked.where(F.col("kind").isin(*L.SPECIAL_KINDS)).orderBy(F.desc("degree"), "id").limit(L.VIEW_EXTRA)
    kept = top.unionByName(special)
    absent = ranked.join(kept.select("producer").distinct(), "producer", "left_anti")
    place = F.row_number().over(Window.partitionBy("producer").orderBy(F.desc("degree"), "id"))
    sample = absent.withColumn("n", place).where(F.col("n") <= L.VIEW_SAMPLE).drop("n")
    ids = kept.unionByName(sample).groupBy("id").agg(F.max("degree").alias("degree")).orderBy(F.desc("degree"), "id").limit(limit + L.VIEW_EXTRA)
    shown = nodes.join(cut(ids.select("id")), "id", "left_semi")
    return shown, traverse.induced(shown, edges)
