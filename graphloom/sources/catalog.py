"""Capture of a catalog: databases, tables and columns as nodes, keys as references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import Batch, as_edges, as_nodes


def shape(uri: str, tables: DataFrame, columns: DataFrame, keys: DataFrame | None = None, foreign: DataFrame | None = None) -> Batch:
    """Rows of an information schema as a batch.

    ``tables(schema, name, kind)``, ``columns(schema, table, name, type, nullable, ordinal)``,
    ``keys(schema, table, column)``, ``foreign(name, schema, table, column, ref_schema,
    ref_table, ref_column)``. A reference is one edge per pair of tables, listing its constraints.
    """
    base = uri.rstrip("/")
    at = lambda *parts: F.concat_ws("/", F.lit(base), *parts)
    name = base.rpartition("/")[2]
    spark = tables.sparkSession
    db = spark.createDataFrame([(base, name, "database")], "id string, label string, kind string")
    schemas = tables.select("schema").distinct().select(at("schema").alias("id"), F.col("schema").alias("label"), F.lit("schema").alias("kind"))
    ts = tables.select(at("schema", "name").alias("id"), F.col("name").alias("label"), "kind")
    pk = F.lit(False)
    if keys is not None:
        columns = columns.join(keys.select("schema", "table", F.col("column").alias("name"), F.lit(True).alias("pk")), ["schema", "table", "name"], "left")
        pk = F.coalesce("pk", F.lit(False))
    meta = F.create_map(F.lit("type"), F.col("type"), F.lit("nullable"), F.col("nullable").cast("string"), F.lit("ordinal"), F.col("ordinal").cast("string"), F.lit("pk"), pk.cast("string"))
    cs = columns.select(at("schema", "table", "name").alias("id"), F.col("name").alias("label"), F.lit("column").alias("kind"), meta.alias("metadata"))
    nodes = reduce(lambda a, b: a.unionByName(b), [as_nodes(x.withColumns({"file_type": F.lit("database"), "source": F.lit(base)})) for x in (db, schemas, ts, cs)])
    inside = lambda df, a, b: df.select(a.alias("source"), b.alias("target"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"))
    parts = [
        inside(tables.select("schema").distinct(), F.lit(base), at("schema")),
        inside(tables, at("schema"), at("schema", "name")),
        inside(columns, at("schema", "table"), at("schema", "table", "name")),
    ]
    edges = [as_edges(p) for p in parts]
    if foreign is not None:
        pair = ["schema", "table", "ref_schema", "ref_table"]
        line = F.concat("column", F.lit("→"), "ref_column")
        each = foreign.groupBy(*pair, "name").agg(F.concat(F.first("name"), F.lit("("), F.array_join(F.sort_array(F.collect_list(line)), ","), F.lit(")")).alias("c"))
        refs = each.groupBy(*pair).agg(F.array_join(F.sort_array(F.collect_list("c")), "; ").alias("constraints"))
        edges.append(as_edges(refs.select(at("schema", "table").alias("source"), at("ref_schema", "ref_table").alias("target"), F.lit("references").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.create_map(F.lit("constraints"), F.col("constraints")).alias("metadata"))))
    return Batch(f"source:{name}", nodes, reduce(lambda a, b: a.unionByName(b), edges))


# Names of indexes and characters of a view's definition that are kept.
INDEX_NAMES, VIEW_CHARS = 20, 400


def details(indexes: DataFrame | None = None, partitions: DataFrame | None = None, views: DataFrame | None = None) -> DataFrame:
    """``schema``, ``table``, ``metadata`` of ``indexes(schema, table, name)``, ``partitions(schema, table)`` (a row each) and ``views(schema, table, definition)``."""
    by, parts = ["schema", "table"], []
    entry = lambda df, k, v: df.select(*by, F.lit(k).alias("k"), v.cast("string").alias("v"))
    if indexes is not None:
        found = indexes.groupBy(*by).agg(F.sort_array(F.collect_set("name")).alias("names"))
        parts += [entry(found, "index_count", F.size("names")), entry(found, "indexes", F.array_join(F.slice("names", 1, INDEX_NAMES), ", "))]
    if partitions is not None:
        parts.append(entry(partitions.groupBy(*by).count(), "partitions", F.col("count")))
    if views is not None:
        long = F.length("definition") > VIEW_CHARS
        parts.append(entry(views, "definition", F.when(long, F.concat(F.substr("definition", F.lit(1), F.lit(VIEW_CHARS)), F.lit("…"))).otherwise(F.col("definition"))))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))


def described(batch: Batch, uri: str, found: DataFrame) -> Batch:
    """A batch of ``shape`` with ``details`` added to the metadata of its tables."""
    more = found.select(F.concat_ws("/", F.lit(uri.rstrip("/")), "schema", "table").alias("id"), F.col("metadata").alias("more"))
    none = F.create_map().cast("map<string,string>")
    nodes = batch.nodes.join(more, "id", "left").withColumn("metadata", F.map_concat("metadata", F.coalesce("more", none))).select(*batch.nodes.columns)
    return Batch(batch.producer, nodes, batch.edges)


def capture(database: str, tables: dict[str, DataFrame], schema: str = "default") -> Batch:
    """The schemas of DataFrames; no data is read."""
    spark = next(iter(tables.values())).sparkSession
    ts = spark.createDataFrame([(schema, t, "table") for t in sorted(tables)], "schema string, name string, kind string")
    rows = [(schema, t, f.name, f.dataType.simpleString(), f.nullable, i) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields, 1)]
    cs = spark.createDataFrame(rows, "schema string, table string, name string, type string, nullable boolean, ordinal int")
    return shape(f"spark://{database}", ts, cs)


def capture_jdbc(spark, url: str, system: tuple[str, ...] = ("information_schema", "pg_catalog", "mysql", "performance_schema", "sys"), **options: str) -> Batch:
    """The information schema of a database that Spark's JDBC source reaches (its driver must be on the class path)."""
    read = lambda q: spark.read.format("jdbc").options(url=url, query=q, **options).load()
    skip = ", ".join(f"'{s}'" for s in system)
    ts = read(f"select table_schema, table_name, table_type from information_schema.tables where table_schema not in ({skip})")
    ts = ts.toDF("schema", "name", "kind").withColumn("kind", F.when(F.lower("kind").contains("view"), "view").otherwise("table"))
    cs = read(f"select table_schema, table_name, column_name, data_type, is_nullable, ordinal_position from information_schema.columns where table_schema not in ({skip})")
    cs = cs.toDF("schema", "table", "name", "type", "nullable", "ordinal").withColumn("nullable", F.lower("nullable") == "yes")
    from .connect import sanitized

    return shape(sanitized(url.removeprefix("jdbc:")), ts, cs)
