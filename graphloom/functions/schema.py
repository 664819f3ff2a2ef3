"""Schemas of nodes and edges; absent optional fields are empty strings, zero and empty maps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _struct(texts: str, numbers: str = "") -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in texts.split()] + [T.StructField(n, T.DoubleType()) for n in numbers.split()]
    return T.StructType([*fields, T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


NODE = _struct("id label kind file_type source location scope")
EDGE = _struct("source target relation confidence", "weight")
CONFIDENCE = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
EDGE_KEY = ("source", "target", "relation")


@dataclass
class Batch:
    """What a producer hands over."""

    producer: str
    nodes: DataFrame
    edges: DataFrame


def _complete(df: DataFrame, schema: T.StructType) -> DataFrame:
    empty = {"string": F.lit(""), "double": F.lit(0.0), "map": F.create_map().cast("map<string,string>")}
    out = []
    for f in schema.fields:
        default = empty[f.dataType.typeName()]
        out.append((F.coalesce(F.col(f.name).cast(f.dataType), default) if f.name in df.columns else default).alias(f.name))
    rest = [c for c in df.columns if c not in schema.names]
    return df.select(*out, *rest)


def as_nodes(df: DataFrame) -> DataFrame:
    return _complete(df, NODE)


def as_edges(df: DataFrame) -> DataFrame:
    return _complete(df, EDGE)


def producer():
    return F.coalesce(F.col("metadata")["producer"], F.lit(""))


def owned(name):
    """``metadata`` with its producer set; other keys stay."""
    name = F.lit(name) if isinstance(name, str) else name
    rest = F.map_filter("metadata", lambda k, v: k != "producer")
    return F.map_concat(rest, F.create_map(F.lit("producer"), name))


def stamped(df: DataFrame, name) -> DataFrame:
    """``df`` with ``metadata['producer']`` set; other keys stay."""
    return df.withColumn("metadata", owned(name))
