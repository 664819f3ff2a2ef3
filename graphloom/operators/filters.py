"""One predicate over nodes and edges: sets of values, prefixes, containment, conditions on any field."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_FIELDS = ("id", "label", "kind", "file_type", "source", "location", "scope")
EDGE_FIELDS = ("source", "target", "relation", "confidence", "weight")


@dataclass(frozen=True)
class Condition:
    key: str
    value: str
    contains: bool = False

    @staticmethod
    def parse(text: str) -> Condition:
        """``k~v`` (contains) or ``k=v`` (equals); the first kind is looked for first."""
        for mark, contains in (("~", True), ("=", False)):
            key, found, value = text.partition(mark)
            if found and key.strip():
                return Condition(key.strip(), value.strip(), contains)
        raise ValueError(f"bad condition {text!r}: want key=value or key~value")

    def column(self, fields: tuple[str, ...]) -> Column:
        value = lookup(self.key, fields)
        test = F.contains(value, F.lit(self.value)) if self.contains else value == self.value
        return F.coalesce(test, F.lit(False))


def lookup(key: str, fields: tuple[str, ...]) -> Column:
    """``metadata.k``, else a field, else a bare metadata key; null if there is none."""
    if key.startswith("metadata."):
        return F.try_element_at("metadata", F.lit(key.removeprefix("metadata.")))
    if key in fields:
        return F.col(key).cast("string")
    return F.try_element_at("metadata", F.lit(key))


@dataclass(frozen=True)
class Predicate:
    """Dimensions are ANDed; the values of a set are ORed. Empty dimensions hold for all."""

    kind: tuple[str, ...] = ()
    file_type: tuple[str, ...] = ()
    label: str = ""
    scope: str = ""
    relation: tuple[str, ...] = ()
    confidence: tuple[str, ...] = ()
    from_id: str = ""
    to_id: str = ""
    id_prefix: str = ""
    producer: str = ""
    where: tuple[Condition, ...] = field(default=())

    @staticmethod
    def parse(flags: dict[str, str]) -> Predicate:
        """From flag texts: a comma separates values of a set, and conditions of ``where``."""
        split = lambda k: tuple(x.strip() for x in flags.get(k, "").split(",") if x.strip())
        return Predicate(
            split("kind"), split("file-type"), flags.get("label", ""), flags.get("scope", ""), split("relation"), split("confidence"),
            flags.get("from", ""), flags.get("to", ""), flags.get("id-prefix", ""), flags.get("producer", ""),
            tuple(map(Condition.parse, split("where"))),
        )

    def _all(self, tests: list[Column]) -> Column:
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def _shared(self, fields: tuple[str, ...]) -> list[Column]:
        tests = [c.column(fields) for c in self.where]
        if self.producer:
            tests.append(F.coalesce(F.try_element_at("metadata", F.lit("producer")) == self.producer, F.lit(False)))
        return tests

    def on_nodes(self) -> Column:
        tests = self._shared(NODE_FIELDS)
        if self.kind:
            tests.append(F.col("kind").isin(*self.kind))
        if self.file_type:
            tests.append(F.col("file_type").isin(*self.file_type))
        if self.id_prefix:
            tests.append(F.col("id").startswith(self.id_prefix))
        if self.label:
            tests.append(F.contains("label", F.lit(self.label)))
        if self.scope:
            scopes = F.coalesce(F.nullif("scope", F.lit("")), F.try_element_at("metadata", F.lit("scopes")), F.lit(""))
            tests.append(F.contains(scopes, F.lit(self.scope)))
        return self._all(tests)

    def on_edges(self) -> Column:
        tests = self._shared(EDGE_FIELDS)
        if self.relation:
            tests.append(F.col("relation").isin(*self.relation))
        if self.confidence:
            tests.append(F.col("confidence").isin(*self.confidence))
        if self.from_id:
            tests.append(F.col("source") == self.from_id)
        if self.to_id:
            tests.append(F.col("target") == self.to_id)
        if self.id_prefix:
            tests.append(F.col("source").startswith(self.id_prefix) | F.col("target").startswith(self.id_prefix))
        return self._all(tests)

    def apply(self, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both streams filtered: dimensions of nodes alone leave edges as they are, and the other way round."""
        return nodes.where(self.on_nodes()), edges.where(self.on_edges())


def select(df: DataFrame, names: list[str], fields: tuple[str, ...]) -> DataFrame:
    """Dotted fields in the order given; a missing one is null."""
    return df.select(*[lookup(n, fields).alias(n) for n in names])


def list_nodes(nodes: DataFrame, predicate: Predicate, names: list[str] | None = None) -> DataFrame:
    out = nodes.where(predicate.on_nodes()).orderBy("id")
    return select(out, names, NODE_FIELDS) if names else out


def list_edges(edges: DataFrame, predicate: Predicate, names: list[str] | None = None) -> DataFrame:
    out = edges.where(predicate.on_edges()).orderBy("source", "target", "relation")
    return select(out, names, EDGE_FIELDS) if names else out
