"""The engine's operators on the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import limits as L
from ..functions import text
from ..functions.schema import producer
from ..functions.tables import written
from ..operators import cards, communities, filters, history, links, records, resolve, search, traverse
from ..sources import catalog
from .demo_graph import GRAPH_SQL, edges, nodes, table
from .registry import ORACLES, QUERIES

NOW = "2024-02-01 00:00:00"
_DEGREE = "degree as (select id, sum(i) as n_in, sum(o) as n_out from (select source as id, 0 as i, 1 as o from edges union all select target, 1, 0 from edges) group by id)"


def query(sql: str | None = None, graph: bool = True) -> Callable:
    """Register a query; ``sql`` may use the tables ``nodes`` and ``edges``."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"with recursive {GRAPH_SQL} {sql}" if graph else sql
        return f

    return put


def g(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return nodes(spark, sf), edges(spark, sf)


def walked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The graph for walks: edges, here made from tables, are written once rather than made again for each level."""
    return nodes(spark, sf), written(edges(spark, sf).select("source", "target", "relation", "confidence"), "walked")


def where(**flags: str) -> filters.Predicate:
    return filters.Predicate.parse({k.replace("_", "-"): v for k, v in flags.items()})


# --- Tables, filters, projections


@query("select id, label, kind, file_type, source from nodes")
def graph_nodes(spark, sf):
    return nodes(spark, sf).select("id", "label", "kind", "file_type", "source")


@query("select source, target, relation, confidence, weight from edges")
def graph_edges(spark, sf):
    return edges(spark, sf).select("source", "target", "relation", "confidence", "weight")


@query("select id, label, kind from nodes where kind in ('supplier', 'nation')")
def nodes_filter_kind(spark, sf):
    return filters.list_nodes(nodes(spark, sf), where(kind="supplier,nation"), ["id", "label", "kind"])


@query("select id, label from nodes where segment = 'BUILDING' and contains(label, '1')")
def nodes_where(spark, sf):
    return filters.list_nodes(nodes(spark, sf), where(where="metadata.segment=BUILDING,label~1"), ["id", "label"])


@query("select id from nodes where starts_with(id, 'supplier:1')")
def nodes_id_prefix(spark, sf):
    return filters.list_nodes(nodes(spark, sf), where(id_prefix="supplier:1"), ["id"])


@query("select id, brand, cast(null as varchar) as nope from nodes where kind = 'part'")
def nodes_select(spark, sf):
    found = filters.list_nodes(nodes(spark, sf), where(kind="part"), ["id", "metadata.brand", "nope"])
    return found.withColumnRenamed("metadata.brand", "brand")


@query("select source, target, relation from edges where relation in ('in_region', 'in_nation')")
def edges_relation(spark, sf):
    return filters.list_edges(edges(spark, sf), where(relation="in_region,in_nation"), ["source", "target", "relation"])


@query("select source, target from edges where confidence = 'INFERRED' and (starts_with(source, 'part:1') or starts_with(target, 'part:1'))")
def edges_confidence(spark, sf):
    return filters.list_edges(edges(spark, sf), where(confidence="INFERRED", id_prefix="part:1"), ["source", "target"])


@query("select kind, count(*) as n from nodes group by kind")
def count_by_kind(spark, sf):
    return nodes(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query("select relation, count(*) as n, sum(weight) as weight from edges group by relation")
def count_by_relation(spark, sf):
    return edges(spark, sf).groupBy("relation").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("select 'tpch' as producer, count(*) as n from nodes")
def count_by_producer(spark, sf):
    return nodes(spark, sf).groupBy(producer().alias("producer")).agg(F.count("*").alias("n"))


# --- Graph


@query("""select distinct e1.target as dep_id, e2.source as importer from edges e2 join edges e1 on e1.source = e2.target
  where e1.relation = 'of_brand' and e2.relation = 'contains'""")
def deps_importers(spark, sf):
    return links.importers(*g(spark, sf), first="of_brand", second="contains", kind="brand")


@query(f", {_DEGREE} select id, label, kind, cast(n_in as bigint) as n_in, cast(n_out as bigint) as n_out, cast(n_in + n_out as bigint) as degree from nodes join degree using (id) order by degree desc, id limit 10")
def hubs(spark, sf):
    return cards.hubs(*g(spark, sf))


@query(f", {_DEGREE} select id, label, kind, cast(n_in as bigint) as n_in, cast(n_out as bigint) as n_out, cast(n_in + n_out as bigint) as degree from nodes join degree using (id) where kind = 'supplier' order by degree desc, id limit 10")
def hubs_in_kind(spark, sf):
    n, e = g(spark, sf)
    return cards.hubs(n.where(where(kind="supplier").on_nodes()), e)


@query("""select dir, relation, string_agg(x, ',' order by x) as ids from (
  select 'out' as dir, relation, target as x from edges where source = 'nation:3' union all
  select 'in', relation, source from edges where target = 'nation:3') group by dir, relation""")
def explain(spark, sf):
    return cards.explain(edges(spark, sf), "nation:3").withColumn("ids", F.array_join("ids", ","))


@query("""select n.id, n.label,
  (select max(source) from edges where target = 'order:7' and relation = 'contains') as parent,
  (select coalesce(string_agg(target, ',' order by target), '') from edges where source = 'order:7' and relation = 'contains') as contains,
  (select coalesce(string_agg(relation || ' → ' || target, ',' order by relation || ' → ' || target), '') from edges where source = 'order:7' and relation <> 'contains') as other
  from nodes n where n.id = 'order:7'""")
def card(spark, sf):
    found = cards.card(*g(spark, sf), "order:7")
    return found.select("id", "label", "parent", F.array_join("contains", ",").alias("contains"), F.array_join("other", ",").alias("other"))


_WALK = """, walk as (
  select '{start}' as id, 0 as depth union
  select e.source, w.depth + 1 from walk w join edges e on e.target = w.id where w.depth < {depth} {extra}
), least as (select id, min(depth) as depth from walk group by id)"""


@query(_WALK.format(start="region:1", depth=2, extra="") + " select n.id, n.kind, depth from least join nodes n using (id) where depth > 0")
def affected(spark, sf):
    return traverse.affected(*walked(spark, sf), "region:1").select("id", "kind", "depth")


@query(_WALK.format(start="supplier:3", depth=2, extra="and e.relation = 'supplied_by'") + " select id, depth from least where depth > 0")
def affected_relation(spark, sf):
    return traverse.affected(*walked(spark, sf), "supplier:3", relations=("supplied_by",)).select("id", "depth")


@query(_WALK.format(start="nation:3", depth=2, extra="") + " select n.id, depth from least join nodes n using (id) where depth > 0 and kind = 'customer'")
def affected_then_filter(spark, sf):
    return traverse.affected(*walked(spark, sf), "nation:3").where(F.col("kind") == "customer").select("id", "depth")


@query(""", both_ways as (select source as a, target as b from edges union all select target, source from edges),
walk as (select 'brand:Brand#2' as id, 0 as depth union select b, depth + 1 from walk join both_ways on a = id where depth < 2)
select id, min(depth) as depth from walk group by id""")
def reachable_depths(spark, sf):
    return traverse.depths(walked(spark, sf)[1], "brand:Brand#2", 2)


@query(""", both_ways as (select source as a, target as b from edges where relation in ('in_nation', 'in_region') union all select target, source from edges where relation in ('in_nation', 'in_region')),
walk as (select 'customer:1' as id, 0 as depth union select b, depth + 1 from walk join both_ways on a = id where depth < 6)
select min(depth) as steps from walk where id = 'nation:14'""")
def shortest_path_length(spark, sf):
    """Null without a path of six steps at most, as in the SQL."""
    near = walked(spark, sf)[1].where(F.col("relation").isin("in_nation", "in_region"))
    try:
        steps = len(traverse.shortest_path(near, "customer:1", "nation:14", 6))
    except traverse.NoPath:
        steps = None
    return spark.createDataFrame([(steps,)], "steps int")


@query()
def shortest_path_steps(spark, sf):
    steps = traverse.shortest_path(walked(spark, sf)[1], "customer:1", "supplier:1")
    return spark.createDataFrame([(i, s.source, s.target, s.relation, s.direction) for i, s in enumerate(steps)], "step int, source string, target string, relation string, direction string")


@query(""", both_ways as (select source as a, target as b from edges union all select target, source from edges),
walk as (select 'nation:3' as id, 0 as depth union select b, depth + 1 from walk join both_ways on a = id where depth < 2)
select id, kind, min(depth) as depth from walk join nodes using (id) group by id, kind order by depth, id limit 100""")
def neighborhood(spark, sf):
    return traverse.neighborhood(*walked(spark, sf), "nation:3", 2, 100).select("id", "kind", "depth")


@query()
def community_groups(spark, sf):
    n, e = g(spark, sf)
    places = n.where(F.col("kind").isin("region", "nation", "supplier", "customer"))
    found = communities.communities(places, traverse.induced(places, e))
    return found.select("community", "size", F.array_join("hubs", ",").alias("hubs"))


@query(_WALK.format(start="customer:7", depth=2, extra="") + """, blast as (select id from least)
select confidence, count(*) as n from edges where source in (select id from blast) and target in (select id from blast) group by confidence""")
def change_plan(spark, sf):
    return cards.change_plan(*walked(spark, sf), "customer:7").confidence.withColumnRenamed("count", "n")


@query()
def viewer_payload(spark, sf):
    n, e = cards.viewer_payload(*g(spark, sf))
    return e.select("source", "target", "relation").orderBy("source", "target", "relation")


# --- Words and search

_APART = r"regexp_replace(regexp_replace({x}, '([^A-Z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
_TOKENS = "list_filter(regexp_extract_all(lower(" + _APART + "), '[a-z0-9]+'), lambda t: length(t) > 1)"
_ALL = ", post as (select distinct id, unnest(" + _TOKENS.format(x="label || ' ' || source") + ") as token from nodes), total as (select count(*) as n from nodes), vocab as (select token, count(*) as df, 0.1 + ln((n + 1) / (1 + count(*))) as idf from post, total group by token, n)"
_POST = ", post as (select distinct id, unnest(" + _TOKENS.format(x="label || ' ' || source") + ") as token from nodes where kind = 'part'), total as (select count(*) as n from nodes where kind = 'part'), vocab as (select token, count(*) as df, 0.1 + ln((n + 1) / (1 + count(*))) as idf from post, total group by token, n)"


def parts(spark, sf):
    return nodes(spark, sf).where(F.col("kind") == "part")


@query("select id, array_to_string(list_sort(list_distinct(" + _TOKENS.format(x="label || ' ' || source") + ")), ',') as tokens from nodes")
def tokenize_nodes(spark, sf):
    words = F.array_distinct(text.tokens(F.concat_ws(" ", "label", "source")))
    return nodes(spark, sf).select("id", F.array_join(F.sort_array(words), ",").alias("tokens"))


@query(_ALL + " select token, df from vocab")
def document_frequency(spark, sf):
    return search.document_frequency(search.postings(nodes(spark, sf)))


@query(_ALL + " select token, floor(idf * 1e6 + 0.5) / 1e6 as idf from vocab")
def idf(spark, sf):
    p = nodes(spark, sf)
    n = p.count()
    return search.document_frequency(search.postings(p)).select("token", (F.floor(text.idf("df", n) * 1e6 + 0.5) / 1e6).alias("idf"))


_MATCH = """, asked as (select unnest(range(len(q))) as pos, unnest(q) as qt from (select [{words}] as q)),
match as (select pos, token, case when token = qt then 1 when length(qt) >= 3 and (starts_with(token, qt) or starts_with(qt, token)) then 2
  when length(token) >= 5 and length(qt) >= 5 and 2.0 * len(list_intersect(tt, tq)) / (len(tt) + len(tq)) >= 0.5 then 3 end as tier, idf
  from (select *, list_distinct([substring(token, i, 3) for i in range(1, length(token) - 1)]) as tt, list_distinct([substring(qt, i, 3) for i in range(1, length(qt) - 1)]) as tq from vocab, asked)),
best as (select id, pos, first(case tier when 1 then 1.0 when 2 then 0.7 else 0.4 end * idf order by tier, idf desc) as w from post join match using (token) where tier is not null group by id, pos),
scored as (select id, sum(w) as s from best group by id),
ranked as (select row_number() over (order by round(s, 9) desc, id) as rank, id, label, source, s from scored join nodes using (id))"""
_SEARCH, _SEARCH_PARTS = _ALL + _MATCH, _POST + _MATCH


def _hits(spark, sf, question, **kw):
    found = search.search(nodes(spark, sf), edges(spark, sf), question, **kw)
    return found.select(F.col("rank").cast("long").alias("rank"), "id", "label", "score")


@query(_SEARCH.format(words="'red', 'widget'") + " select rank, id, label, floor(s * 100 + 0.5) / 100 as score from ranked where rank <= 20")
def search_words(spark, sf):
    return _hits(spark, sf, "red widget", budget=10**6)


@query(_SEARCH.format(words="'red', 'widget'") + """, near as (select source as id, target as other, source as s, target as t, relation as r from edges union all select target, source, source, target, relation from edges where source <> target),
top as (select id, other, r, row_number() over (partition by id order by s, t, r) as k from near join (select id from ranked where rank <= 20) using (id)),
costs as (select id, sum(strlen(other) + strlen(r) + 8) as c from top where k <= 12 group by id),
costed as (select ranked.*, (strlen(ranked.id) + strlen(label) + strlen(source) + 16 + coalesce(c, 0)) // 4 as cost from ranked left join costs using (id) where rank <= 20)
select rank, id, label, floor(s * 100 + 0.5) / 100 as score from (select *, sum(cost) over (order by rank) as spent from costed) where rank = 1 or spent <= 700""")
def search_budget(spark, sf):
    return _hits(spark, sf, "red widget", budget=700)


@query(_SEARCH.format(words="'widgett', 'smal'") + " select rank, id, label, floor(s * 100 + 0.5) / 100 as score from ranked where rank <= 20")
def search_typo(spark, sf):
    return _hits(spark, sf, "widgett smal", budget=10**6)


@query(_SEARCH_PARTS.format(words="'small', 'red', 'ring'") + """, near as (select source as id, target as other, source as s, target as t, relation as r from edges
  union all select target, source, source, target, relation from edges where source <> target),
top as (select id, other, row_number() over (partition by id order by s, t, r) as k from near)
select rank, ranked.id, label, floor(ranked.s * 100 + 0.5) / 100 as score, count(k) as n_neighbors, coalesce(string_agg(other, ',' order by k), '') as neighbors
from ranked left join top on ranked.id = top.id and k <= 12 where rank <= 20 group by rank, ranked.id, label, ranked.s""")
def search_parts(spark, sf):
    """The flagship: ranked parts with their neighbours. The kind narrows before ranks are made, so idf is of parts."""
    found = search.search(parts(spark, sf), edges(spark, sf), "small red ring", budget=10**6)
    near = F.array_join(F.transform("neighbors", lambda x: x["id"]), ",").alias("neighbors")
    return found.select(F.col("rank").cast("long").alias("rank"), "id", "label", "score", F.size("neighbors").cast("long").alias("n_neighbors"), near)


@query()
def search_documents(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("label"), F.lit("document").alias("kind"), F.lit("text").alias("file_type"), F.coalesce("source", F.lit("")).alias("source"))
    from ..functions.schema import as_nodes

    return search.search(as_nodes(d), edges(spark, sf).where("false"), "license of the other thing").select("rank", "id", "score")


@query(""", t as (select label, list_distinct([substring(lower(label), i, 3) for i in range(1, length(label) - 1)]) as g from (select distinct label from nodes)),
q as (select list_distinct([substring('nation_33', i, 3) for i in range(1, 8)]) as h)
select label, floor(d * 1e6 + 0.5) / 1e6 as dice from (select label, 2.0 * len(list_intersect(g, h)) / (len(g) + len(h)) as d from t, q where len(g) > 0) where d >= 0.3 order by d desc, label limit 3""")
def did_you_mean(spark, sf):
    found = resolve.suggestions(nodes(spark, sf), "NATION_33")
    return found.select("label", (F.floor(F.col("dice") * 1e6 + 0.5) / 1e6).alias("dice"))


@query("""select * from (
  (select 'nation:3' as name, 'exact-id' as via, id from nodes where id = 'nation:3') union all
  (select 'nation_4', 'exact-label', min(id) from nodes where lower(label) = 'nation_4') union all
  (select 'world::NATION_5', 'last-segment', min(id) from nodes where lower(label) = 'nation_5'))""")
def resolve_tiers(spark, sf):
    n = nodes(spark, sf)
    rows = [(name, (r := resolve.resolve(n, name)).via, r.node.id) for name in ("nation:3", "nation_4", "world::NATION_5")]
    return spark.createDataFrame(rows, "name string, via string, id string")


# --- Joins

_COMMITS = """with recent as (select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 500),
touched as (select distinct l_orderkey as c, 'supplier:' || l_suppkey as p from lineitem join recent on l_orderkey = o_orderkey),
sized as (select c, p from touched qualify count(*) over (partition by c) <= 20),
pairs as (select x.p as a, y.p as b, count(*) as support from sized x join sized y on x.c = y.c and x.p < y.p group by 1, 2 having count(*) >= {least})
select a, b, support{more} from pairs order by support desc, a, b limit 200"""


def _pairs(spark, sf):
    o = table(spark, sf, "orders")
    order = F.struct("o_orderdate", "o_orderkey")
    commits = o.select(F.col("o_orderkey").alias("commit_id"), order.alias("seq"), F.lit(False).alias("is_merge"))
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("supplier:"), "l_suppkey").alias("path"))
    return history.cochanges(commits, files)


@query(_COMMITS.format(least=3, more=""), graph=False)
def cochange_pairs(spark, sf):
    return _pairs(spark, sf).drop("ratio")


@query(_COMMITS.format(least=3, more=", printf('%.2f', support / (select count(*) from sized where p = a)) as ratio"), graph=False)
def cochange_ratio(spark, sf):
    return _pairs(spark, sf)


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query(f"""with names as (select distinct {_HOST} || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as name from pages),
rules as (select distinct {_HOST} as prefix from pages union select distinct {_HOST} || '/' || split_part(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/', 2) from pages)
select name, max_by(prefix, length(prefix)) as prefix from (select n.name, r.prefix from names n join rules r on n.name = r.prefix or starts_with(n.name, r.prefix || '/')) group by name""", graph=False)
def prefix_link(spark, sf):
    p = table(spark, sf, "pages")
    host, path = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    names = p.select(F.concat(host, path).alias("name")).distinct()
    first = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(2)), F.lit(""))
    rules = p.select(host.alias("prefix")).union(p.select(F.concat(host, F.lit("/"), first))).distinct()
    return links.longest_prefix(names, rules)


@query(f"""with h as (select distinct {_HOST} as name from pages), rules as (select distinct split_part(name, '.', 1) as prefix, array_to_string(string_split(name, '.')[-2:], '.') as target from h)
select name, min(target) as target from h join rules on name = prefix or starts_with(name, prefix || '.') group by name having count(distinct target) = 1""", graph=False)
def unambiguous_link(spark, sf):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    h = table(spark, sf, "pages").select(host.alias("name")).distinct()
    rules = h.select(F.substring_index("name", ".", 1).alias("prefix"), F.substring_index("name", ".", -2).alias("target")).distinct()
    return links.unambiguous_prefix(h, rules)


@query("""with i as (select 'm' || p_partkey as module_id, '@' || p_type || '/' || replace(p_name, ' ', '-') || '/x' as spec from part)
select distinct module_id, '@' || split_part(substring(spec, 2), '/', 1) || '/' || split_part(spec, '/', 2) as package from i where not starts_with(spec, '@ECONOMY/')""", graph=False)
def undeclared(spark, sf):
    p = table(spark, sf, "part")
    imports = p.select(F.concat(F.lit("m"), "p_partkey").alias("module_id"), F.concat(F.lit("@"), "p_type", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/x")).alias("spec"))
    package = text.npm_package("spec")
    declared = imports.where(package.startswith("@ECONOMY/")).select(F.concat(F.lit("dep:npm/"), package).alias("dep_id"), F.lit("npm").alias("ecosystem"), package.alias("name")).distinct()
    none = spark.createDataFrame([], "path string")
    return links.undeclared(imports, links.resolve_imports(imports, declared, none))


@query("""with d as (select 'part:' || p_partkey as id, p_brand as file, p_name as name from part),
c as (select id as caller, file, lag(name) over (order by id) as name from d),
n as (select name, count(*) as n, min(id) as id from d group by name), h as (select name, file, count(*) as n, min(id) as id from d group by name, file)
select distinct caller, callee from (select caller, case when h.n = 1 then h.id when h.n is null and n.n = 1 then n.id end as callee
  from c join n using (name) left join h on h.name = c.name and h.file = c.file) where callee is not null and callee <> caller""", graph=False)
def unique_name_resolution(spark, sf):
    d = table(spark, sf, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_name").alias("name"))
    before = F.lag("name").over(Window.orderBy("id"))  # makes the fixture's calls; not part of the operator
    return links.resolve_calls(d.select(F.col("id").alias("caller"), "file", before.alias("name")), d)


@query("""select 'svc:' || s.brand || ':' || s.p_type as service, 'part:' || p_partkey as workload from (select distinct p_brand as brand, p_type from part) s
  join part p on p.p_brand = s.brand and p.p_type = s.p_type""", graph=False)
def selector_match(spark, sf):
    p = table(spark, sf, "part")
    tags = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    work = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lit("default").alias("namespace"), tags.alias("labels"))
    kinds = p.select("p_brand", "p_type").distinct()
    services = kinds.select(F.concat(F.lit("svc:"), "p_brand", F.lit(":"), "p_type").alias("id"), F.lit("default").alias("namespace"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("selector"))
    return links.select_workloads(services, work)


@query("select 'user:' || user_id as target, string_agg(distinct event_type, ',' order by event_type) as scopes from events group by user_id", graph=False)
def scope_union(spark, sf):
    return links.scope_union(table(spark, sf, "events").select(F.concat(F.lit("user:"), "user_id").alias("target"), F.col("event_type").alias("scope_class")))


@query(", m as (select 'tpch' as name, 'tpch' as path union all select 'parts', 'tpch/part' union all select 'orders', 'tpch/orders') select kind, max_by(m.name, length(m.path)) as module, id from nodes join m on starts_with(source, m.path || '/') group by kind, id")
def module_owner(spark, sf):
    n = nodes(spark, sf)
    m = spark.createDataFrame([("tpch", "tpch"), ("parts", "tpch/part"), ("orders", "tpch/orders")], "name string, path string")
    return links.module_of(n.select("id", "kind", F.col("source").alias("path")), m).select("id", "kind", "module")


@query(f", {_DEGREE}, r as (select kind, label, row_number() over (partition by kind order by n_in + n_out desc, id) as k from nodes join degree using (id)) select kind as module, count(*) as nodes, (select string_agg(label, ',' order by k) from r where r.kind = n.kind and k <= 3) as hubs from nodes n group by kind")
def module_index(spark, sf):
    n, e = g(spark, sf)
    found = links.index_modules(n.withColumn("module", F.col("kind")), e.withColumn("module", F.substring_index("source", ":", 1)), hub_cap=3)
    return found.select("module", "nodes", F.array_join("hubs", ",").alias("hubs"))


@query("select kind as name, cast((case when contains(kind, 'part') then 1 else 0 end) + (case when contains(kind, 'order') then 1 else 0 end) as int) as matches from (select distinct kind from nodes) where contains(kind, 'part') or contains(kind, 'order')")
def module_rank(spark, sf):
    index = nodes(spark, sf).select(F.col("kind").alias("name")).distinct().select("name", F.col("name").alias("path"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("hubs"))
    return links.rank_modules(index, ["part", "order"]).select("name", "matches")


# --- Logs

_USAGE = "with u as (select ts, event_type as verb, cast(floor(value * 100) as bigint) as bytes, event_id % 1000 as ms from events) "


def _usage(spark, sf):
    return table(spark, sf, "events").select("ts", F.col("event_type").alias("verb"), F.floor(F.col("value") * 100).cast("long").alias("bytes"), (F.col("event_id") % 1000).alias("ms"))


@query(_USAGE + "select verb, count(*) as count, cast(sum(bytes) as bigint) as bytes, cast(floor(sum(ms) / count(*)) as bigint) as avg_ms from u group by verb", graph=False)
def usage_by_verb(spark, sf):
    return records.usage_by_verb(_usage(spark, sf))


@query(_USAGE + "select cast(cast(ts as date) as varchar) as day, count(*) as count from u group by 1", graph=False)
def usage_by_day(spark, sf):
    return records.usage_by_day(_usage(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query(_USAGE + """select count(*) as total, cast(sum(bytes) as bigint) as bytes, count(*) filter (cast(ts as date) = date '2024-01-30') as today, count(*) filter (cast(ts as date) > date '2024-01-23') as last_7_days,
 cast(sum(case when verb = 'hook-context' then 0 else greatest(0, 7600 - bytes // 4) end) as bigint) as saved_tokens, cast(sum(bytes) // 4 as bigint) as est_tokens,
 cast(sum(case when verb = 'hook-context' then 0 else greatest(0, 7600 - bytes // 4) end) as double) / 1e6 * 3.0 as saved_usd from (select * replace (case when verb = 'click' then 'hook-context' else verb end as verb) from u)""", graph=False)
def usage_saved(spark, sf):
    u = _usage(spark, sf).withColumn("verb", F.when(F.col("verb") == "click", "hook-context").otherwise(F.col("verb")))
    return records.usage_summary(u, F.lit("2024-01-30").cast("date"))


_FEED = f"""with r as (select unnest([source, lang]) as node, case when toxic = 1 then -1.0 when quality = 1 then 1.0 when quality = 0 then -1.0 end as s,
  greatest(0, epoch(timestamp '{NOW}' - (timestamp '2024-01-01' + to_minutes(doc_id))) / 86400.0) as age from labels join documents using (doc_id)),
f as (select node, sum(s * pow(0.5, age / 30)) as score, count(*) filter (s > 0) as useful from r where s is not null and node is not null group by node) """


def _results(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    outcome = F.when(F.col("toxic") == 1, "dead_end").when(F.col("quality") == 1, "useful").when(F.col("quality") == 0, "corrected").otherwise("")
    when = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 60)
    return d.select(F.lit("q").alias("question"), F.lit("").alias("correction"), F.array("source", "lang").alias("nodes"), outcome.alias("outcome"), when.alias("when"))


_r6 = lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6


@query(_FEED + "select node, floor(score * 1e6 + 0.5) / 1e6 as score, useful from f", graph=False)
def feedback_scores(spark, sf):
    return records.feedback_scores(_results(spark, sf), F.lit(NOW).cast("timestamp")).withColumn("score", _r6("score"))


@query(_FEED + "select node, floor(score * 1e6 + 0.5) / 1e6 as score, useful from f where score > 0 and useful >= 2", graph=False)
def feedback_lessons(spark, sf):
    return records.lessons(_results(spark, sf), F.lit(NOW).cast("timestamp"))[0].withColumn("score", _r6("score"))


@query("select case when bool_or(o_orderstatus = 'O') then 'stale' else 'fresh' end as state, case when bool_or(o_orderstatus = 'O') then 1 else 0 end as exit_code from orders", graph=False)
def freshness_overall(spark, sf):
    o = table(spark, sf, "orders")
    s = o.select(F.col("o_orderkey").cast("string").alias("path"), F.lit("h1").alias("head"), F.lit(100).alias("head_unix"), F.when(F.col("o_orderstatus") == "O", "h2").otherwise("h1").alias("current"), F.lit(160).alias("current_unix"))
    return records.overall(records.freshness(s))


@query(""", c as (select unnest(['nation:3', 'nation_4', 'nope', 'tpch/region/0:L1-L2', 'tpch/region/0:L9']) as claim) select claim, case when not regexp_matches(claim, ':L[0-9]+') then case when exists (select 1 from nodes where id = claim or lower(label) = lower(claim)) then 'ok' else 'missing-node' end
  when not exists (select 1 from nodes where source = regexp_extract(claim, '^(.+):L', 1)) then 'missing-file' when cast(regexp_extract(claim, '([0-9]+)$', 1) as int) > 3 then 'out-of-range' else 'ok' end as verdict from c""")
def verify_claims(spark, sf):
    n = nodes(spark, sf)
    claims = spark.createDataFrame([(c,) for c in ("nation:3", "nation_4", "nope", "tpch/region/0:L1-L2", "tpch/region/0:L9")], "claim string")
    files = n.select(F.col("source").alias("path"), F.lit(3).alias("lines"), F.lit(False).alias("changed"))
    return records.verify(claims, n, files).select("claim", "verdict")


# --- Texts


@query("""select 'page:' || page_id as source, href as target, count(*) as n from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages) group by 1, 2""", graph=False)
def page_links(spark, sf):
    p = table(spark, sf, "pages").select(F.concat(F.lit("page:"), "page_id").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return p.groupBy("source", "target").agg(F.count("*").alias("n"))


@query("select id, case when s = '' then 'node' else s end as slug from (select id, regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as s from nodes)")
def slugs(spark, sf):
    return nodes(spark, sf).select("id", text.slug("label").alias("slug"))


@query("select doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) as body from documents where text is not null", graph=False)
def body_slice(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.body_slice("text", F.lit(2), F.lit(3)).alias("body"))


_TABLES = "('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')"


@query(f"""with c as (select distinct table_name as t, column_name as c from information_schema.columns where table_name in {_TABLES})
select 'spark://local' as id, 'local' as label, 'database' as kind union all select 'spark://local/default', 'default', 'schema' union all select distinct 'spark://local/default/' || t, t, 'table' from c union all select 'spark://local/default/' || t || '/' || c, c, 'column' from c""", graph=False)
def schema_catalog(spark, sf):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    batch = catalog.capture("local", {n: table(spark, sf, n) for n in names})
    return batch.nodes.select("id", "label", "kind")


@query("select event_type, window_start, n from (select event_type, cast(date_trunc('day', ts) as varchar) as window_start, count(*) as n from events group by 1, 2)", graph=False)
def daily_windows(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return e.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")
