"""Exports of the two tables, and the pages made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions import text
from ..functions.schema import producer
from ..operators.cards import degrees


def _lean(df: DataFrame):
    """JSON of a row without empty optional fields."""
    fields = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f.name)
        empty = F.size(c) == 0 if kind == "map" else c == (0.0 if kind == "double" else "")
        optional = f.name in ("location", "scope", "weight", "metadata")
        fields.append((F.when(~empty, c) if optional else c).alias(f.name))
    return F.to_json(F.struct(*fields))


def ndjson(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``value``: nodes by id, then edges by key, a JSON object a line."""
    n = nodes.select(F.lit(0).alias("g"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), _lean(nodes).alias("value"))
    e = edges.select(F.lit(1).alias("g"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation").alias("c"), _lean(edges).alias("value"))
    return n.unionByName(e).orderBy("g", "a", "b", "c").select("value")


def _document(head: list[str], *parts: DataFrame, tail: list[str]) -> DataFrame:
    """Lines in order: ``parts(key, value)`` sorted by key within each part."""
    spark = parts[0].sparkSession
    out = spark.createDataFrame([(0, f"{i:04d}", x) for i, x in enumerate(head)], "g int, key string, value string")
    for g, p in enumerate(parts, 1):
        out = out.unionByName(p.select(F.lit(g).alias("g"), "key", "value"))
    end = spark.createDataFrame([(99, f"{i:04d}", x) for i, x in enumerate(tail)], "g int, key string, value string")
    return out.unionByName(end).orderBy("g", "key").select("value")


def _edge_key():
    return F.concat_ws("\u0000", "source", "target", "relation")


def json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One document ``{"nodes": [..], "edges": [..]}`` as lines."""
    n = nodes.select(F.col("id").alias("key"), _lean(nodes).alias("v"))
    e = edges.select(_edge_key().alias("key"), _lean(edges).alias("v"))

    def listed(df: DataFrame) -> DataFrame:
        last = df.agg(F.max("key").alias("last"))
        comma = F.when(F.col("key") == F.col("last"), "").otherwise(",")
        return df.crossJoin(last).select("key", F.concat("v", comma).alias("value"))  # one row

    middle = nodes.sparkSession.createDataFrame([("", '],"edges":[')], "key string, value string")
    return _document(['{"nodes":['], listed(n), middle, listed(e), tail=["]}"])


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    label = text.quoted(F.concat("label", F.lit("\n("), "kind", F.lit(")")))
    n = nodes.select(F.col("id").alias("key"), F.concat(F.lit("  "), text.quoted("id"), F.lit(" [label="), label, F.lit("];")).alias("value"))
    e = edges.select(_edge_key().alias("key"), F.concat(F.lit("  "), text.quoted("source"), F.lit(" -> "), text.quoted("target"), F.lit(" [label="), text.quoted("relation"), F.lit("];")).alias("value"))
    return _document(["digraph g {"], n, e, tail=["}"])


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sorted; empty optional fields are left out."""

    def data(pairs) -> list:
        return [F.when(test, F.concat(F.lit(f'<data key="{k}">'), text.xml_escaped(c), F.lit("</data>"))).otherwise("") for k, c, test in pairs]

    always = F.lit(True)
    own = [(k, F.col(k), always) for k in ("label", "kind", "file_type", "source")] + [("location", F.col("location"), F.col("location") != ""), ("producer", producer(), producer() != "")]
    n = nodes.select(F.col("id").alias("key"), F.concat(F.lit('    <node id="'), text.xml_escaped("id"), F.lit('">'), *data(own), F.lit("</node>")).alias("value"))
    tags = [("relation", F.col("relation"), always), ("confidence", F.col("confidence"), always), ("weight", F.col("weight").cast("string"), F.col("weight") != 0)]
    ends = (F.lit('    <edge source="'), text.xml_escaped("source"), F.lit('" target="'), text.xml_escaped("target"), F.lit('">'))
    e = edges.select(_edge_key().alias("key"), F.concat(*ends, *data(tags), F.lit("</edge>")).alias("value"))
    keys = [f'  <key id="{k}" for="node" attr.name="{k}" attr.type="string"/>' for k, _, _ in own]
    keys += [f'  <key id="{k}" for="edge" attr.name="{k}" attr.type="{"double" if k == "weight" else "string"}"/>' for k, _, _ in tags]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '  <graph edgedefault="directed">']
    return _document(head, n, e, tail=["  </graph>", "</graphml>"])


def csv(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seven and five columns, sorted; write them with a header."""
    n = nodes.select("id", "label", "kind", "file_type", "source", "location", producer().alias("producer")).orderBy("id")
    return n, edges.select("source", "target", "relation", "confidence", "weight").orderBy("source", "target", "relation")


def write_all(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Every format under one folder, each a Spark output folder."""
    for name, made in (("json", json), ("ndjson", ndjson), ("dot", dot), ("graphml", graphml)):
        made(nodes, edges).coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    for name, df in zip(("nodes", "edges"), csv(nodes, edges)):
        df.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/csv/{name}")
    notes(nodes, edges).write.mode("overwrite").json(f"{path}/notes")


def notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``name``, ``body``: a Markdown note per node (not import stubs), linked with each other by name.

    Names are slugs of labels; later ones in the order of ids get -2, -3, ..
    """
    real = nodes.where("kind <> 'module'").withColumn("slug", text.slug("label"))
    k = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
    real = real.withColumn("k", k).withColumn("name", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("k").cast("string"))))
    taken = real.where("k = 1").select(F.col("slug").alias("name"), F.lit(True).alias("taken"))
    clash = (F.col("k") > 1) & F.coalesce("taken", F.lit(False))
    real = real.join(taken, "name", "left").withColumn("name", F.when(clash, F.concat("name", F.lit("-"), F.substring(F.sha2("id", 256), 1, 6))).otherwise(F.col("name")))
    names = real.select("id", "name")
    out = edges.join(names.withColumnRenamed("id", "source").withColumnRenamed("name", "from_name"), "source")
    out = out.join(names.withColumnRenamed("id", "target").withColumnRenamed("name", "to_name"), "target")
    lines = out.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), "relation", F.lit(" [["), "to_name", F.lit("]]")))), "\n").alias("links"))
    body = F.concat(F.lit("# "), "label", F.lit("\n\nkind: "), "kind", F.lit("\nsource: "), "source", F.lit("\n\n"), F.coalesce("links", F.lit("")))
    return real.join(lines.withColumnRenamed("source", "id"), "id", "left").select("name", body.alias("body")).orderBy("name")


def wiki_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``section``, ``name``, ``n``: kinds, relations, the first 20 hubs, files."""
    kinds = nodes.groupBy(F.col("kind").alias("name")).count().select(F.lit("kind").alias("section"), "name", "count")
    rels = edges.groupBy(F.col("relation").alias("name")).count().select(F.lit("relation").alias("section"), "name", "count")
    ranked = nodes.join(degrees(edges), "id").select(F.lit("hub").alias("section"), F.col("id").alias("name"), (F.col("n_in") + F.col("n_out")).alias("count"))
    top = ranked.orderBy(F.desc("count"), "name").limit(L.WIKI_HUBS)
    files = nodes.where("kind = 'file'").select(F.lit("file").alias("section"), F.col("id").alias("name"), F.lit(1).cast("long").alias("count"))
    return kinds.unionByName(rels).unionByName(top).unionByName(files).withColumnRenamed("count", "n").orderBy("section", F.desc("n"), "name")


def wiki_pages(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """``id``, ``body``: a page for each node in ``of(id)``; a relation's list is cut at 30 with a count of the rest."""
    out = edges.select(F.col("source").alias("id"), F.concat("relation", F.lit(" →")).alias("r"), F.col("target").alias("x"))
    into = edges.select(F.col("target").alias("id"), F.concat("relation", F.lit(" ←")).alias("r"), F.col("source").alias("x"))
    near = out.unionByName(into).join(of, "id", "left_semi")
    w = Window.partitionBy("id", "r")
    near = near.withColumn("k", F.row_number().over(w.orderBy("x"))).withColumn("n", F.count("*").over(w)).where(F.col("k") <= L.WIKI_RELATION)
    lists = near.groupBy("id", "r", "n").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), text.table_cell("x")))), "\n").alias("l"))
    more = F.when(F.col("n") > L.WIKI_RELATION, F.concat(F.lit("\n- … "), (F.col("n") - L.WIKI_RELATION).cast("string"), F.lit(" more"))).otherwise("")
    parts = lists.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("## "), "r", F.lit("\n\n"), "l", more))), "\n\n").alias("p"))
    named = nodes.join(of, "id", "left_semi").join(parts, "id", "left")
    return named.select("id", F.concat(F.lit("# "), "label", F.lit("\n\n"), "kind", F.lit(" in "), "source", F.lit("\n\n"), F.coalesce("p", F.lit(""))).alias("body"))


def lessons_text(preferred: DataFrame, dead: DataFrame, fixes: DataFrame) -> str:
    """The lessons page, byte for byte the same for the same rows. Lists of a curated log: read by the driver."""
    out = ["# Lessons", "", "## Preferred", ""]
    out += [f"- {r.node} ({r.score:.2f}, {r.useful} useful)" for r in preferred.collect()]
    out += ["", "## Dead ends", ""] + [f"- {r.node} ({r.score:.2f})" for r in dead.collect()]
    out += ["", "## Corrections", ""] + [f"- {r.question}: {r.correction}" for r in fixes.collect()]
    return "\n".join(out) + "\n"


def navigator(index: DataFrame, root: str) -> DataFrame:
    """``value``: the front page of modules (``index`` of ``links.index_modules`` with ``path`` and ``summary``), line by line."""
    n = index.count()
    cells = [text.table_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("module", "path", "nodes", "edges", "summary")]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    table = index.select(F.col("path").alias("key"), row.alias("value"))
    shown = F.array_join(F.slice("hubs", 1, 10), ", ")
    body = F.concat(F.lit("\n## "), "module", F.lit("\nhubs: "), shown, F.lit("\nwiki: ["), "path", F.lit("](../"), "path", F.lit("/wiki/index.md)"))
    hubs = index.where(F.size("hubs") > 0).select(F.col("path").alias("key"), body.alias("value"))
    head = [f"# {root}: modules", "", f"{n} modules", "", "| module | path | nodes | edges | about |", "|---|---|---:|---:|---|"]
    return _document(head, table, hubs, tail=[])


def navigator_json(index: DataFrame) -> DataFrame:
    """``value``: a JSON object per module, by path."""
    return index.orderBy("path").select(F.to_json(F.struct(F.col("module").alias("name"), "path", "nodes", "edges", "hubs", "summary")).alias("value"))


def usage_csv(usage: DataFrame) -> DataFrame:
    """Six columns in the order of time; write them with a header."""
    return usage.orderBy("ts").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "verb", F.coalesce("arg", F.lit("")).alias("arg"), "hits", "bytes", "ms")


def stale_pages(before: DataFrame, now: DataFrame) -> DataFrame:
    """Pages of ``before(id)`` that ``now(id)`` has no more: what an update of the wiki removes."""
    return before.select("id").join(now.select("id"), "id", "left_anti").orderBy("id")
