"""What a name means: exact id, exact label, last segment, token overlap; refuses to guess between equals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions import text
from .search import query_tokens


class NoNode(LookupError):
    def __init__(self, name: str, suggestions: list[str]):
        super().__init__(f"no node for {name!r}" + (f"; did you mean {', '.join(suggestions)}?" if suggestions else ""))
        self.suggestions = suggestions


class Ambiguous(LookupError):
    def __init__(self, name: str, candidates: list[Row]):
        super().__init__(f"{name!r} may be any of {', '.join(c.id for c in candidates)}")
        self.candidates = candidates


@dataclass(frozen=True)
class Resolved:
    node: Row
    via: str


def candidates(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes of the best tier: ``tier`` (1 id, 2 label, 3 last segment, 4 overlap), ``overlap``, ``stub``.

    One pass: a tier and a count per node, and only those with the least tier and, in
    the last tier, the largest overlap.
    """
    base = name.strip()
    for mark in ("/", "::", "."):
        base = base.rpartition(mark)[2]
    asked = query_tokens(name)
    have = F.array_distinct(text.tokens(F.concat_ws(" ", "label", "id")))
    overlap = sum((F.array_contains(have, t).cast("int") for t in asked), F.lit(0))
    tier = F.when(F.col("id") == name, 1).when(F.lower("label") == name.lower(), 2)
    if base and base.lower() != name.lower():
        tier = tier.when(F.lower("label") == base.lower(), 3)
    tier = tier.when((overlap > 0) & (overlap * 2 >= len(asked)), 4)
    ranked = nodes.select("*", tier.alias("tier"), overlap.alias("overlap"), text.is_stub("id").alias("stub")).where("tier is not null")
    best = ranked.agg(F.min(F.struct("tier", F.when(F.col("tier") == 4, -F.col("overlap")).otherwise(0).alias("o"))).alias("b"))
    same = (F.col("tier") == F.col("b.tier")) & ((F.col("tier") < 4) | (F.col("overlap") == -F.col("b.o")))
    return ranked.join(F.broadcast(best), same).drop("b")  # one row


def resolve(nodes: DataFrame, name: str, fuzzy: bool = False) -> Resolved:
    """Declarations come before import stubs, then the smallest id; distinct labels that overlap alike are ambiguous."""
    found = candidates(nodes, name)
    best = found.orderBy("stub", "id").first()
    if best is None:
        raise NoNode(name, [r.label for r in suggestions(nodes, name).collect()])
    if best.tier == 4 and not fuzzy:
        rivals = found.where(F.col("stub") == best.stub).groupBy("label").agg(F.min("id").alias("id")).orderBy("id").limit(L.CANDIDATES).collect()
        if len(rivals) > 1:
            raise Ambiguous(name, rivals)
    return Resolved(best, ("exact-id", "exact-label", "last-segment", "fuzzy")[best.tier - 1])


def suggestions(nodes: DataFrame, name: str, limit: int = L.SUGGESTIONS) -> DataFrame:
    """Labels whose trigrams are near the name's, or its last segment's, whichever is nearer: ``label``, ``dice``."""
    base = name.strip()
    for mark in ("/", "::", "."):
        base = base.rpartition(mark)[2]
    grams = lambda s: [s[i : i + 3] for i in range(len(s) - 2)]
    own = lambda s: F.array(*[F.lit(g) for g in dict.fromkeys(grams(s.lower()))]).cast("array<string>")
    labels = nodes.select("label").distinct().withColumn("grams", text.trigrams(F.lower("label")))
    labels = labels.select("label", F.greatest(*(text.dice(F.col("grams"), own(s)) for s in (name, base))).alias("dice"))
    return labels.where(F.col("dice") >= L.SUGGEST_DICE).orderBy(F.desc("dice"), "label").limit(limit)
