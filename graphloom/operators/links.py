"""Joins that tie names to what they mean: imports to dependencies, calls to declarations, paths to modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.tables import cut, small

# Modules that come with the runtime.
NODE_BUILTINS = (
    "assert", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "dns", "domain", "events", "fs", "http",
    "http2", "https", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "stream",
    "string_decoder", "timers", "tls", "tty", "url", "util", "v8", "vm", "worker_threads", "zlib",
)


def longest_prefix(names: DataFrame, rules: DataFrame, mark: str = "/") -> DataFrame:
    """``names(name)`` and ``rules(prefix, ..)``: the rule with the longest prefix that ends at a ``mark`` or is the whole.

    Each name is exploded into its prefixes, so this is an equi-join, not a range join.
    """
    parts = names.select("name").distinct().withColumn("prefix", F.explode(text.prefixes("name", mark)))
    met = parts.join(rules, "prefix")
    best = met.groupBy("name").agg(F.max_by(F.struct(*rules.columns), F.struct(F.length("prefix"), "prefix")).alias("r"))
    return best.select("name", "r.*")


def unambiguous_prefix(names: DataFrame, rules: DataFrame, mark: str = ".") -> DataFrame:
    """``rules(prefix, target)``: the target if exactly one distinct rule target matches any prefix of the name."""
    parts = names.select("name").distinct().withColumn("prefix", F.explode(text.prefixes("name", mark)))
    met = parts.join(rules, "prefix").groupBy("name").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    return met.where("n = 1").select("name", "target")


def resolve_imports(imports: DataFrame, dependencies: DataFrame, self_modules: DataFrame) -> DataFrame:
    """``imports(module_id, spec)`` to ``dependencies(dep_id, ecosystem, name)``: ``module_id``, ``spec``, ``dep_id``.

    npm by package, else go by the longest path prefix (a module's own paths excluded),
    else maven by an unambiguous group, else nuget by an unambiguous id prefix. Built-in
    and relative specifiers have no link.
    """
    spec = F.col("spec")
    outside = ~spec.rlike(r"^(\.|/|node:)") & ~spec.isin(*NODE_BUILTINS)
    named = imports.where(outside).withColumn("name", spec).withColumn("package", text.npm_package("spec"))
    of = lambda eco: dependencies.where(F.col("ecosystem") == eco)
    npm = of("npm").groupBy(F.col("name").alias("package")).agg(F.min("dep_id").alias("npm_id"))
    go = longest_prefix(named, of("go").select(F.col("name").alias("prefix"), F.col("dep_id").alias("go_id"))).select("name", "go_id")
    own = longest_prefix(named, self_modules.select(F.col("path").alias("prefix"))).select("name").distinct()
    go = go.join(own, "name", "left_anti")
    group = F.substring_index("name", ":", 1)
    maven = unambiguous_prefix(named, of("maven").select(group.alias("prefix"), F.col("dep_id").alias("target"))).withColumnRenamed("target", "maven_id")
    nuget = unambiguous_prefix(named, of("nuget").select(F.col("name").alias("prefix"), F.col("dep_id").alias("target"))).withColumnRenamed("target", "nuget_id")
    out = named.join(npm, "package", "left").join(go, "name", "left").join(maven, "name", "left").join(nuget, "name", "left")
    return out.withColumn("dep_id", F.coalesce("npm_id", "go_id", "maven_id", "nuget_id")).where("dep_id is not null").select("module_id", "spec", "dep_id")


def undeclared(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """Scoped packages (``@scope/name``) that are imported and declared nowhere: ``module_id``, ``package``."""
    left = imports.where(F.col("spec").startswith("@")).join(resolved.select("module_id", "spec"), ["module_id", "spec"], "left_anti")
    return left.select("module_id", text.npm_package("spec").alias("package")).distinct()


def importers(nodes: DataFrame, edges: DataFrame, first: str = "resolves_to", second: str = "imports", kind: str = "dependency") -> DataFrame:
    """``dep_id``, ``importer``: who imports a module that resolves to a dependency. Of several targets of a module the greatest counts."""
    to = edges.where(F.col("relation") == first).groupBy(F.col("source").alias("via")).agg(F.max("target").alias("dep_id"))
    use = edges.where(F.col("relation") == second).select(F.col("target").alias("via"), F.col("source").alias("importer"))
    deps = nodes.where(F.col("kind") == kind).select(F.col("id").alias("dep_id"))
    return to.join(use, "via").join(deps, "dep_id", "left_semi").select("dep_id", "importer").distinct()


def resolve_calls(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """``calls(caller, file, name)`` to ``declarations(id, file, name)``: ``caller``, ``callee``.

    The only declaration in the caller's file, else the only one at all; otherwise, and
    for calls of oneself, nothing. Declarations are counted per name first, so a name
    with very many of them meets no call more than twice.
    """
    here = declarations.groupBy("name", "file").agg(F.count("*").alias("n_here"), F.min("id").alias("id_here"))
    all_ = declarations.groupBy("name").agg(F.count("*").alias("n_all"), F.min("id").alias("id_all"))
    met = calls.join(all_, "name").join(here, ["name", "file"], "left")
    callee = F.when(F.col("n_here") == 1, F.col("id_here")).when(F.col("n_here").isNull() & (F.col("n_all") == 1), F.col("id_all"))
    return met.select("caller", callee.alias("callee")).where("callee is not null and callee <> caller").distinct()


def select_workloads(services: DataFrame, workloads: DataFrame) -> DataFrame:
    """``services(id, namespace, selector)`` to ``workloads(id, namespace, labels)`` whose labels hold the selector.

    Workloads get, for each set of keys that selectors of their namespace have, their values of
    these keys, and are joined on all of them: a pair that very many have is never joined alone.
    """
    s = services.where(F.size("selector") > 0).withColumn("keys", F.array_sort(F.map_keys("selector")))
    s = s.select(F.col("id").alias("service"), "namespace", "keys", F.transform("keys", lambda k: F.try_element_at("selector", k)).alias("values"))
    sets = s.select("namespace", "keys").distinct().groupBy("namespace").agg(F.collect_list("keys").alias("sets"))
    w = workloads.select(F.col("id").alias("workload"), "namespace", "labels").join(sets, "namespace")
    w = w.select("workload", "namespace", "labels", F.explode("sets").alias("keys"))
    w = w.select("workload", "namespace", "keys", F.transform("keys", lambda k: F.try_element_at("labels", k)).alias("values"))
    met = s.where(~F.exists("values", F.isnull)).join(w.where(~F.exists("values", F.isnull)), ["namespace", "keys", "values"])
    return met.select("service", "workload")


def scope_union(declares: DataFrame) -> DataFrame:
    """``declares(target, scope_class)``: ``target``, ``scopes`` (sorted, distinct, comma-joined)."""
    return declares.where("scope_class is not null and scope_class <> ''").groupBy("target").agg(F.array_join(F.sort_array(F.collect_set("scope_class")), ",").alias("scopes"))


def module_of(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """``paths(path)`` and ``modules(name, path)``: the deepest module that holds each path, null if none."""
    rules = modules.where("path is not null").groupBy(F.col("path").alias("prefix")).agg(F.max("name").alias("m"))
    rules = cut(rules.withColumn("depth", F.size(F.split("prefix", "/"))))
    sizes = {r.depth: r["count"] for r in rules.groupBy("depth").count().collect()}
    # A join for each depth that modules have, the deepest first; modules are few, so paths needn't be moved.
    out, names = paths, []
    for depth in sorted(sizes, reverse=True):
        names.append(f"__m{depth}")
        own = small(rules.where(F.col("depth") == depth).select(F.col("prefix").alias("__p"), F.col("m").alias(names[-1])), sizes[depth])
        out = out.withColumn("__p", F.substring_index("path", "/", depth)).join(own, "__p", "left").drop("__p")
    module = F.coalesce(*names, F.lit(None).cast("string"))
    return out.select("path", *[c for c in paths.columns if c != "path"], module.alias("module"))


def owners(index: DataFrame, label: str) -> DataFrame:
    """Modules of ``index(name, hubs)`` with a hub of that label, or one that ends in ``.label`` or ``::label``."""
    hub = F.col("hub")
    each = index.select("name", F.explode("hubs").alias("hub"))
    return each.where((hub == label) | hub.endswith(f".{label}") | hub.endswith(f"::{label}")).select("name").distinct()


def rank_modules(index: DataFrame, terms: list[str]) -> DataFrame:
    """Modules by how many of the terms their name, path, summary or hubs hold, then by path."""
    hay = F.lower(F.concat_ws(" ", "name", "path", "summary", F.array_join("hubs", " ")))
    n = sum((F.contains(hay, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    return index.withColumn("matches", n).where("matches > 0").orderBy(F.desc("matches"), "path")


def index_modules(nodes: DataFrame, edges: DataFrame, summaries: DataFrame | None = None, hub_cap: int = 100) -> DataFrame:
    """Per ``module``: ``nodes``, ``edges``, ``hubs`` (labels by degree, capped), ``summary``."""
    from .cards import degrees

    ranked = nodes.join(degrees(edges), "id").withColumn("n", F.row_number().over(Window.partitionBy("module").orderBy(F.desc(F.col("n_in") + F.col("n_out")), "id")))
    top = ranked.where(F.col("n") <= hub_cap).groupBy("module").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]).alias("hubs"))
    out = nodes.groupBy("module").agg(F.count("*").alias("nodes")).join(edges.groupBy("module").agg(F.count("*").alias("edges")), "module", "left")
    out = out.join(top, "module", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    if summaries is not None:
        out = out.join(summaries.select("module", "summary"), "module", "left")
    return out.orderBy("module")
