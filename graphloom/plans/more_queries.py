"""Extractors, exports, the store, streams and table changes on texts and graphs made from the driver's tables.

Texts of files are made from rows, so that SQL on the same rows tells what the extractors
must find in them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.schema import Batch, producer, stamped
from ..functions.tables import cut, shared_folder
from ..operators import cards, communities, filters, links, mutate, records, traverse
from ..sources import export, extract
from ..sources.store import Store, listing, missing_stores, orphan_stores
from ..streaming import logs
from .demo_graph import edges, nodes, table
from .queries import g, query, walked, where


def _folder(spark: SparkSession, name: str) -> str:
    shared_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _files(rows: DataFrame, path: Column, line: Column, order: str, head: str = "", tail: str = "", sep: str = "\n") -> DataFrame:
    """``path``, ``content``: a line of each row, in order, between a head and a tail."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("l")))), lambda x: x["l"])
    return rows.groupBy(path.alias("path")).agg(F.concat(F.lit(head), F.array_join(lines, sep), F.lit(tail)).alias("content"))


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _found(files: DataFrame) -> DataFrame:
    return cut(extract.rows(files))


# --- Manifests


def _odd(yes: str, no: str) -> Column:
    return F.when(F.col("p_size") % 2 == 1, F.lit(yes)).otherwise(F.lit(no))


def _manifests(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    k, n = _s("p_partkey"), _s("p_size")
    at = lambda name: F.concat(F.col("p_brand"), F.lit("/" + name))
    made = [
        _files(p, at("package.json"), F.concat(F.lit('"p'), k, F.lit('":"'), n, F.lit('"')), "p_partkey", '{"dependencies":{', "}}", ","),
        _files(p, at("go.mod"), F.concat(F.lit("\tx.org/p"), k, F.lit(" v"), n, _odd(" // indirect", "")), "p_partkey", "module m\n\nrequire (\n", "\n)\n"),
        _files(p, at("build.gradle"), F.concat(_odd("testImplementation", "api"), F.lit(" 'g:p"), k, F.lit(":"), n, F.lit("'")), "p_partkey"),
        _files(p, at("pom.xml"), F.concat(F.lit("<dependency><groupId>h</groupId><artifactId>p"), k, F.lit("</artifactId><version>"), n, F.lit("</version>"), _odd("<scope>provided</scope>", ""), F.lit("</dependency>")), "p_partkey", "<project><dependencies>", "</dependencies></project>"),
        _files(p, at("a.csproj"), F.concat(F.lit('<PackageReference Include="p'), k, F.lit('" Version="'), n, F.lit('" />')), "p_partkey", "<Project><ItemGroup>", "</ItemGroup></Project>"),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


_DECLARES = " union all ".join(
    f"select p_brand || '/{file}' as source, 'dep:{eco}/{pre}' || p_partkey as target, '{v}' || p_size as version, {scope} as scope, {label} as scope_class from part"
    for file, eco, pre, v, scope, label in (
        ("package.json", "npm", "p", "", "'dependencies'", "'runtime'"),
        ("go.mod", "go", "x.org/p", "v", "case when p_size % 2 = 1 then 'indirect' else 'require' end", "case when p_size % 2 = 1 then 'indirect' else 'runtime' end"),
        ("build.gradle", "maven", "g:p", "", "case when p_size % 2 = 1 then 'testImplementation' else 'api' end", "case when p_size % 2 = 1 then 'test' else 'runtime' end"),
        ("pom.xml", "maven", "h:p", "", "case when p_size % 2 = 1 then 'provided' else 'compile' end", "case when p_size % 2 = 1 then 'build' else 'runtime' end"),
        ("a.csproj", "nuget", "p", "", "'package'", "'runtime'"),
    )
)


@query(_DECLARES, graph=False)
def manifest_declares(spark, sf):
    m = F.col("metadata")
    found = _found(_manifests(spark, sf)).where("relation = 'declares'")
    return found.select("source", "target", m["version_spec"].alias("version"), m["scope"].alias("scope"), m["scope_class"].alias("scope_class"))


@query("select p_brand || '/Makefile::task:p' || p_partkey as id, 'make:p' || p_partkey as label, 'L' || (2 * row_number() over (partition by p_brand order by p_partkey) - 1) as location from part", graph=False)
def manifest_tasks(spark, sf):
    p = table(spark, sf, "part")
    files = _files(p, F.concat("p_brand", F.lit("/Makefile")), F.concat(F.lit("p"), _s("p_partkey"), F.lit(":\n\techo")), "p_partkey")
    return _found(files).where("kind = 'task'").select("id", "label", "location")


@query("select p_brand || '/package.json' as dir, 'dep:npm/p' || p_partkey as dep_id from part where p_partkey % 3 = 0", graph=False)
def declared_imports(spark, sf):
    """Each brand's manifest against imports of every third of its parts: what the imports resolve to."""
    found = _found(_manifests(spark, sf).where("path like '%package.json'")).where("relation = 'declares'")
    deps = found.select(F.col("target").alias("dep_id"), F.lit("npm").alias("ecosystem"), F.substring_index("target", "/", -1).alias("name"))
    used = found.withColumn("k", F.substring_index("target", "/p", -1).cast("long")).where("k % 3 = 0")
    imports = used.select(F.col("source").alias("module_id"), F.concat(F.lit("p"), "k", F.lit("/lib/x")).alias("spec"))
    met = links.resolve_imports(imports, deps, spark.createDataFrame([], "path string"))
    return met.select(F.col("module_id").alias("dir"), "dep_id")


@query("select 'k8s://default/service/s' || p_partkey as source, 'k8s://default/deployment/p' || p_partkey as target, 'selects' as relation from part union all select 'k8s://default/deployment/p' || p_partkey, 'image:r/' || p_type, 'uses_image' from part", graph=False)
def kubernetes_edges(spark, sf):
    p = table(spark, sf, "part")
    k = _s("p_partkey")
    doc = F.concat(
        F.lit("apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: p"), k, F.lit("\nspec:\n  template:\n    metadata:\n      labels:\n        app: p"), k,
        F.lit("\n    spec:\n      containers:\n        - name: c\n          image: r/"), F.col("p_type"),
        F.lit("\n---\napiVersion: v1\nkind: Service\nmetadata:\n  name: s"), k, F.lit("\nspec:\n  selector:\n    app: p"), k,
    )
    files = _files(p, F.concat("p_brand", F.lit("/deploy.yaml")), doc, "p_partkey", sep="\n---\n")
    found = next(b for b in extract.batches(files) if b.producer == "manifests")
    return found.edges.where("relation in ('selects', 'uses_image')").select("source", "target", "relation")


# --- Documents, keys, sources

_SECTION = "select 'docs/' || c_nationkey || '.md' as path, c_name, c_mktsegment, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as k from customer"
_SLUG = "replace(lower(c_name), '#', '-')"


def _documents(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    line = F.concat(F.lit("## "), "c_name", F.lit("\nsee [["), "c_mktsegment", F.lit("]] and [x](../s/"), _s("c_custkey"), F.lit(".md#y)"))
    return _files(c, F.concat(F.lit("docs/"), _s("c_nationkey"), F.lit(".md")), line, "c_custkey", "# All\n")


@query(f"with s as ({_SECTION}) select path || '::' || {_SLUG} as id, c_name as label, 'L' || (2 * k) || '-L' || (2 * k + 1) as location, path || '::all' as parent from s", graph=False)
def markdown_sections(spark, sf):
    found = _found(_documents(spark, sf))
    up = found.where("relation = 'contains'").select(F.col("target").alias("id"), F.col("source").alias("parent"))
    return found.where("kind = 'section' and label <> 'All'").select("id", "label", "location").join(up, "id")


@query(f"with s as ({_SECTION}) select path || '::' || {_SLUG} as source, c_mktsegment as target, 'INFERRED' as confidence from s union all select path || '::' || {_SLUG}, 's/' || c_custkey || '.md', 'EXTRACTED' from s", graph=False)
def markdown_links(spark, sf):
    return _found(_documents(spark, sf)).where("relation = 'references'").select("source", "target", "confidence")


@query("select 'conf/' || n_regionkey || '.properties#' || replace(lower(n_name), '_', '-') as id, n_name as label, 'config' as file_type, 'L' || row_number() over (partition by n_regionkey order by n_nationkey) as location from nation", graph=False)
def config_keys(spark, sf):
    n = table(spark, sf, "nation")
    files = _files(n, F.concat(F.lit("conf/"), _s("n_regionkey"), F.lit(".properties")), F.concat("n_name", F.lit(" = "), _s("n_nationkey")), "n_nationkey")
    return _found(files).where("kind = 'config_key'").select("id", "label", "file_type", "location")


@query("select 'api/' || c_nationkey || '.yaml::route:GET /c' || c_custkey as id, 'GET /c' || c_custkey as label, 'L' || (3 * row_number() over (partition by c_nationkey order by c_custkey) + 1) as location from customer", graph=False)
def yaml_routes(spark, sf):
    c = table(spark, sf, "customer")
    line = F.concat(F.lit("  /c"), _s("c_custkey"), F.lit(":\n    get:\n      summary: x"))
    files = _files(c, F.concat(F.lit("api/"), _s("c_nationkey"), F.lit(".yaml")), line, "c_custkey", "openapi: 3.0.0\npaths:\n")
    return _found(files).where("kind = 'route'").select("id", "label", "location")


_FUNCTIONS = "select p_brand || '.py' as path, 'p' || p_partkey as name, row_number() over (partition by p_brand order by p_partkey) as k from part"


def _sources(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    line = F.concat(F.lit("def p"), _s("p_partkey"), F.lit("(a):\n    'D.'\n    return first(a)"))
    return _files(p, F.concat("p_brand", F.lit(".py")), line, "p_partkey", "def first(a):\n    return a\n")


@query(f"with f as ({_FUNCTIONS}) select path || '::' || name as id, 'function' as kind, 'L' || (3 * k) || '-L' || (3 * k + 2) as location, 'def ' || name || '(a)' as signature, 'D.' as doc from f", graph=False)
def python_declarations(spark, sf):
    found = _found(_sources(spark, sf)).where("kind = 'function' and label <> 'first'")
    return found.select("id", "kind", "location", F.col("metadata")["signature"].alias("signature"), F.col("metadata")["doc"].alias("doc"))


@query(f"with f as ({_FUNCTIONS}) select path || '::' || name as source, path || '::first' as target from f", graph=False)
def python_calls(spark, sf):
    found = next(b for b in extract.batches(_sources(spark, sf)) if b.producer == "code")
    return found.edges.where("relation = 'calls'").select("source", "target")


# --- Store and exports


@query("select id, label, kind, file_type, source from nodes")
def store_round_trip(spark, sf):
    s = Store(spark, _folder(spark, "store"))
    s.write(*g(spark, sf))
    return s.nodes().select("id", "label", "kind", "file_type", "source")


@query("select 'b' as key, 'orphan' as state from region where r_regionkey = 0 union all select 'd', 'missing' from region where r_regionkey = 0 union all select key, n || ' nodes' from (select 'a' as key, count(*) as n from region union all select 'b', count(*) from region)", graph=False)
def stores_listed(spark, sf):
    """Stores on disk, those that nobody declared and declared ones that are not there."""
    at, n, e = _folder(spark, "stores"), *g(spark, sf)
    for key in ("a", "b"):
        Store(spark, f"{at}/{key}").write(n.where("kind = 'region'"), e.where("false"))
    found, declared = listing(spark, at), spark.createDataFrame([("a",), ("d",)], "key string")
    states = found.select("key", F.concat("nodes", F.lit(" nodes")).alias("state"))
    states = states.unionByName(orphan_stores(found, declared).withColumn("state", F.lit("orphan")))
    return states.unionByName(missing_stores(found, declared).withColumn("state", F.lit("missing")))


@query(r"""select 'digraph g {' as value union all select '}' union all select '  "' || id || '" [label="' || label || '\n(' || kind || ')"];' from nodes
union all select '  "' || source || '" -> "' || target || '" [label="' || relation || '"];' from edges""")
def export_dot(spark, sf):
    return export.dot(*g(spark, sf))


@query("""select '    <edge source="' || source || '" target="' || target || '"><data key="relation">' || relation || '</data><data key="confidence">' || confidence || '</data>'
 || case when weight <> 0 then '<data key="weight">' || weight || '</data>' else '' end || '</edge>' as value from edges""")
def export_graphml_edges(spark, sf):
    return export.graphml(*g(spark, sf)).where("value like '    <edge %'")


@query("""select '{"source":"' || source || '","target":"' || target || '","relation":"' || relation || '","confidence":"' || confidence || '"' || case when weight <> 0 then ',"weight":' || weight else '' end || ',"metadata":{"producer":"tpch"}}' as value from edges""")
def export_ndjson_edges(spark, sf):
    n, e = g(spark, sf)
    return export.ndjson(n.where("false"), e)


@query("select id, label, kind, file_type, source, '' as location, 'tpch' as producer from nodes")
def export_csv_nodes(spark, sf):
    return export.csv(*g(spark, sf))[0]


@query("select strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, event_type as verb, 'user ' || user_id as arg, 1 as hits, event_id as bytes, event_id % 1000 as ms from events", graph=False)
def export_usage_csv(spark, sf):
    e = table(spark, sf, "events")
    return export.usage_csv(e.select("ts", F.col("event_type").alias("verb"), F.concat(F.lit("user "), "user_id").alias("arg"), F.lit(1).alias("hits"), F.col("event_id").alias("bytes"), (F.col("event_id") % 1000).alias("ms")))


@query(""", d as (select source as id, count(*) as n from (select source from edges union all select target from edges) group by 1)
select 'kind' as section, kind as name, count(*) as n from nodes group by kind union all select 'relation', relation, count(*) from edges group by relation
union all select * from (select 'hub', id, n from d join nodes using (id) order by n desc, id limit 20)""")
def wiki_index(spark, sf):
    return export.wiki_index(*g(spark, sf))


@query("select 'order:' || o_orderkey as id from orders where o_orderstatus = 'F'", graph=False)
def wiki_stale_pages(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), "o_orderstatus")
    return export.stale_pages(o, o.where("o_orderstatus <> 'F'"))


_INDEXED = """, d as (select id, count(*) as deg from (select source as id from edges union all select target from edges) group by id),
r as (select kind, label, row_number() over (partition by kind order by deg desc, id) as k from nodes join d using (id)), m as (select kind, count(*) as n from nodes group by kind)"""


@query(_INDEXED + """ select '# demo: modules' as value union all select '' union all select (select count(*) from m) || ' modules' union all select '' union all select '| module | path | nodes | edges | about |' union all select '|---|---|---:|---:|---|'
union all select '| ' || kind || ' | tpch/' || kind || ' | ' || n || ' | ' || (select count(*) from edges where split_part(source, ':', 1) = m.kind) || ' | ' || kind || 's |' from m
union all select chr(10) || '## ' || kind || chr(10) || 'hubs: ' || string_agg(label, ', ' order by k) || chr(10) || 'wiki: [tpch/' || kind || '](../tpch/' || kind || '/wiki/index.md)' from r where k <= 10 group by kind""")
def navigator_page(spark, sf):
    n, e = g(spark, sf)
    about = n.select(F.col("kind").alias("module")).distinct().withColumn("summary", F.concat("module", F.lit("s")))
    index = links.index_modules(n.withColumn("module", F.col("kind")), e.withColumn("module", F.substring_index("source", ":", 1)), about)
    return export.navigator(index.withColumn("path", F.concat(F.lit("tpch/"), "module")), "demo")


# --- Filters


@query("select id from nodes where contains(label, 'ring') and kind = 'part'")
def nodes_label(spark, sf):
    return filters.list_nodes(nodes(spark, sf), where(kind="part", label="ring"), ["id"])


@query("select source, target, relation from edges where source = 'order:7' union all select source, target, relation from edges where target = 'nation:3' and relation = 'in_nation'")
def edges_from_to(spark, sf):
    e = edges(spark, sf)
    want = ["source", "target", "relation"]
    return filters.list_edges(e, filters.Predicate.parse({"from": "order:7"}), want).unionByName(filters.list_edges(e, filters.Predicate.parse({"to": "nation:3", "relation": "in_nation"}), want))


@query("select id, 'node' as part from nodes where kind = 'nation' union all select source || '>' || target, 'edge' from edges where starts_with(source, 'nation:') or starts_with(target, 'nation:')")
def both_streams(spark, sf):
    """A kind leaves edges as they are; a prefix and a producer hold for both."""
    n, e = filters.Predicate.parse({"kind": "nation", "id-prefix": "nation:", "producer": "tpch"}).apply(*g(spark, sf))
    return n.select("id", F.lit("node").alias("part")).unionByName(e.select(F.concat("source", F.lit(">"), "target").alias("id"), F.lit("edge").alias("part")))


# --- Walks and cards


@query("""select n.id, n.kind, 1 as depth, e.via, e.depends_on, cast(row_number() over (order by n.id) as int) as place
from (select source as id, min(relation) as via, 'nation:3' as depends_on from edges where target = 'nation:3' group by source) e join nodes n using (id)""")
def affected_first_level(spark, sf):
    return traverse.affected(*walked(spark, sf), "nation:3", 1).select("id", "kind", "depth", "via", "depends_on", "place")


@query("""select other, more from (select string_agg(x, ',' order by x) filter (k <= 15) as other, greatest(count(*) - 15, 0) as more
from (select x, row_number() over (order by x) as k from (select relation || ' → ' || target as x from edges where source = 'nation:3' union all select relation || ' ← ' || source from edges where target = 'nation:3' and source <> 'nation:3')))""")
def card_of_hub(spark, sf):
    return cards.card(*g(spark, sf), "nation:3").select(F.array_join("other", ",").alias("other"), F.col("hidden.other").alias("more"))


@query(""", i as (select source as id, row_number() over (order by source) as k, count(*) over () as n from edges where target = 'customer:7' and relation = 'placed_by')
select id, greatest(n - 15, 0) as hidden from i where k <= 15""")
def change_plan_impacts(spark, sf):
    return cards.change_plan(*walked(spark, sf), "customer:7").impacts.select("id", "hidden")


@query("select p_brand || ' (tpch/part)' as community, count(*) + 1 as size, 'brand:' || p_brand as first from part group by p_brand", graph=False)
def brand_communities(spark, sf):
    """Parts and brands: every brand is a community of its own."""
    n, e = g(spark, sf)
    found = communities.communities(n.where("kind in ('part', 'brand')"), e.where("relation = 'of_brand'"))
    return found.select("community", "size", F.element_at("members", 1).alias("first"))


@query("select p_brand || ' (tpch/part)' as community, count(*) + 1 as size, 'brand:' || p_brand as hub from part group by p_brand", graph=False)
def brand_components(spark, sf):
    n, e = g(spark, sf)
    found = communities.communities(n.where("kind in ('part', 'brand')"), e.where("relation = 'of_brand'"), method="lpa")
    return found.select("community", "size", F.element_at("hubs", 1).alias("hub"))


# --- Logs


@query("select event_type as verb, cast(cast(ts as date) as varchar) as day, count(*) as count, cast(sum(event_id) as bigint) as bytes from events group by 1, 2", graph=False)
def streamed_usage(spark, sf):
    """The usage log as a stream of files, folded by day and verb."""
    at, name = _folder(spark, "usage"), f"daily_{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    logs.append(e.select("ts", F.col("event_type").alias("verb"), F.lit("").alias("arg"), F.lit(1).alias("hits"), F.col("event_id").alias("bytes"), F.lit(1).alias("ms")), at)
    daily = logs.daily_usage(logs.stream_log(spark, at, logs.USAGE))
    daily.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("verb", F.col("day").cast("string").alias("day"), "count", "bytes")


@query("select 'q' || doc_id as question, 'fix ' || doc_id as correction from labels where quality = 0 and coalesce(toxic, 0) <> 1", graph=False)
def feedback_corrections(spark, sf):
    d = table(spark, sf, "labels")
    outcome = F.when(F.col("toxic") == 1, "dead_end").when(F.col("quality") == 0, "corrected").otherwise("useful")
    rows = d.select(F.concat(F.lit("q"), "doc_id").alias("question"), F.concat(F.lit("fix "), "doc_id").alias("correction"), F.array(F.lit("n")).alias("nodes"), outcome.alias("outcome"), F.timestamp_seconds("doc_id").alias("when"))
    return records.lessons(rows, F.timestamp_seconds(F.lit(10**9)))[2].select("question", "correction")


@query("select sum(coalesce(cast(quality as double), 0)) as total, count(*) as questions, sum(coalesce(cast(quality as double), 0)) >= 10 as passed from labels", graph=False)
def judged_marks(spark, sf):
    return records.judged(table(spark, sf, "labels").select(F.col("doc_id").alias("question"), F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("mark")), 10.0)


# --- Names


@query("""select p_partkey, p_size % 4 <> 3 as is_test, p_size % 4 in (0, 1, 2) as is_plan_test, cast(p_partkey as varchar) as last, p_brand || '/' || p_type as dir from part""", graph=False)
def names_of_paths(spark, sf):
    p = table(spark, sf, "part")
    k = _s("p_partkey")
    name = F.concat(k, F.element_at(F.array(F.lit("_test.go"), F.lit("/tests/x.py"), F.lit(".spec.ts"), F.lit(".go")), (F.col("p_size") % 4 + 1).cast("int")))
    path = F.concat(F.lit("src/"), name)
    deep = F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), k)
    return p.select("p_partkey", text.is_test_path(path).alias("is_test"), text.is_plan_test(path).alias("is_plan_test"), text.last_segment(F.concat("p_brand", F.lit("::a."), k)).alias("last"), text.parent_dir(deep).alias("dir"))


@query("""select p_partkey, p_partkey as first, p_partkey + p_size as last, case p_size % 3 when 0 then 'dev' when 1 then 'test' end as scope,
 '/' || p_type || '/x' as route, p_type || '/b' as safe, '&lt;' || p_type || '&amp;&quot;' as xml, replace(p_brand, '/', '-') as module, '@' || p_type || '/n' as package, p_size % 2 = 0 as secret from part""", graph=False)
def names_of_parts(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    first, last = text.location_lines(F.concat(F.lit("L"), k, F.lit("-L"), k + F.col("p_size")))
    raw = F.element_at(F.array(F.lit("devDependencies"), F.lit("testRuntime"), F.lit("other")), (F.col("p_size") % 3 + 1).cast("int"))
    return p.select(
        "p_partkey", first.cast("long").alias("first"), last.cast("long").alias("last"), text.scope_class(raw).alias("scope"), text.route_path(F.concat(F.lit("/"), "p_type", F.lit("/")), F.lit("x")).alias("route"),
        text.safe_path(F.concat(F.lit("-"), "p_type", F.lit("./b-"))).alias("safe"), text.xml_escaped(F.concat(F.lit("<"), "p_type", F.lit('&"'))).alias("xml"), text.default_module_name("p_brand").alias("module"),
        text.npm_package(F.concat(F.lit("@"), "p_type", F.lit("/n/sub"))).alias("package"), text.is_secret_name(F.concat(F.lit("a/"), _odd("plain.py", "My-Secret.txt"))).alias("secret"),
    )


@query("select page_id, regexp_replace(url, '[?#].*$', '') as web, 's3://h/' || page_id || '?a=1' as other from pages", graph=False)
def urls_sanitized(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", text.sanitized_url("url").alias("web"), text.sanitized_url(F.concat(F.lit("s3://u:p@h/"), "page_id", F.lit("?token=x&a=1"))).alias("other"))


@query("""select o_orderkey, case when s < 60 then s || 's' when s < 3600 then s // 60 || 'm' when s < 172800 then s // 3600 || 'h' else s // 86400 || 'd' end as age, left(o_orderpriority, 7) as sha, left(o_orderstatus || o_orderpriority, 3) as clip
from (select *, o_orderkey * 37 as s from orders)""", graph=False)
def display_texts(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", text.age_text(F.col("o_orderkey") * 37).alias("age"), text.short_sha("o_orderpriority").alias("sha"), text.clipped(F.concat("o_orderstatus", "o_orderpriority"), 3).alias("clip"))


# --- Changes of whole graphs


def _rows(n: DataFrame, e: DataFrame) -> DataFrame:
    own = n.select(F.lit("node").alias("part"), F.col("id").alias("key"), F.col("label").alias("value"), producer().alias("producer"))
    key = F.concat_ws(">", "source", "target", "relation")
    return own.unionByName(e.select(F.lit("edge").alias("part"), key.alias("key"), F.col("weight").cast("string").alias("value"), producer().alias("producer")))


_EDGE = "source || '>' || target || '>' || relation"


@query(f"select 'node' as part, id as key, label || '!' as value, case when kind = 'brand' then 'b' else 'a' end as producer from nodes union all select 'edge', {_EDGE}, cast(weight + 1 as varchar), case when relation = 'supplied_by' then 'b' else 'a' end from edges")
def merge_graph(spark, sf):
    """All of the graph, changed, merged into a store that lacks brands and suppliers' edges: rows that were there keep their producer."""
    n, e = g(spark, sf)
    new = Batch("b", n.withColumn("label", F.concat("label", F.lit("!"))), e.withColumn("weight", F.col("weight") + 1))
    return _rows(*mutate.merge(stamped(n.where("kind <> 'brand'"), "a"), stamped(e.where("relation <> 'supplied_by'"), "a"), new))


@query(f"select 'node' as part, id as key, label as value, case when kind in ('customer', 'nation') then 'a' else 'b' end as producer from nodes where kind <> 'customer' or segment <> 'BUILDING' union all select 'edge', {_EDGE}, cast(weight as varchar), case when relation = 'in_nation' then 'a' else 'b' end from edges where relation <> 'placed_by'")
def replace_graph(spark, sf):
    """A producer of customers restates itself without some of them, and takes over the nations."""
    n, e = g(spark, sf)
    n = stamped(n, F.when(F.col("kind") == "customer", "a").otherwise("b"))
    e = stamped(e, F.when(F.col("relation").isin("placed_by", "in_nation"), "a").otherwise("b"))
    keep = n.where("kind = 'nation' or kind = 'customer' and metadata['segment'] <> 'BUILDING'")
    done = mutate.replace(n, e, Batch("a", keep, e.where("relation = 'in_nation'")))
    return _rows(done.nodes, done.edges)


@query("""select id, 'label is required' as reason from nodes where segment = 'BUILDING' union all select id, 'duplicate id in batch' from nodes where kind = 'nation'
union all select source || '->' || target, 'confidence is unknown' from edges where relation = 'of_brand'
union all select source || '->' || target, 'dangling: endpoint quarantined this batch' from edges where relation <> 'of_brand' and (source in (select id from nodes where segment = 'BUILDING') or target in (select id from nodes where segment = 'BUILDING'))""")
def quarantine_graph(spark, sf):
    n, e = g(spark, sf)
    n = n.withColumn("label", F.when(F.try_element_at("metadata", F.lit("segment")) == "BUILDING", "").otherwise(F.col("label")))
    e = e.withColumn("confidence", F.when(F.col("relation") == "of_brand", "X").otherwise(F.col("confidence")))
    return mutate.partition(Batch("a", n.unionByName(n.where("kind = 'nation'")), e)).quarantine


@query("select 'm1/' || id as key, 'm1' as module from nodes union all select 'm2/' || id, 'm2' from nodes union all select 'm1/' || source || '>m1/' || target, 'm1' from edges union all select 'm2/' || source || '>m2/' || target, 'm2' from edges")
def federated_graph(spark, sf):
    n, e = g(spark, sf)
    fn, fe = mutate.federate([("m1", n, e), ("m2", n, e)], mode="all")
    return fn.select(F.col("id").alias("key"), "module").unionByName(fe.select(F.concat("source", F.lit(">"), "target").alias("key"), "module"))


@query(f"select 'node' as part, id as key, label as value, case when kind = 'part' then 'merge:two' else 'merge:one' end as producer from nodes union all select 'edge', {_EDGE}, cast(weight as varchar), 'merge:one' from edges")
def merged_stores(spark, sf):
    """Two stores: the second's rows win, producers of rows that the first has stay."""
    n, e = g(spark, sf)
    bare = lambda df: df.withColumn("metadata", F.map_filter("metadata", lambda k, v: k != "producer"))
    return _rows(*mutate.merge_stores([("one", bare(n.where("kind <> 'part'").withColumn("label", F.lit("old"))), bare(e)), ("two", bare(n), bare(e.where("false")))]))
