"""Small fixtures with known facts for the graph operators."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions.schema import Batch, as_edges, as_nodes
from graphloom.functions.text import is_test_path, round2, scope_class, tokens, trigrams
from graphloom.operators import cards, communities, filters, history, links, mutate, records, resolve, search, traverse


def make_nodes(spark, rows):
    """(id, label, kind[, source[, metadata]])"""
    full = [(r[0], r[1], r[2], "code", r[3] if len(r) > 3 else f"src/{r[0]}.go", r[4] if len(r) > 4 else {}) for r in rows]
    return as_nodes(spark.createDataFrame(full, "id string, label string, kind string, file_type string, source string, metadata map<string,string>"))


def make_edges(spark, rows):
    return as_edges(spark.createDataFrame([(a, b, r, "EXTRACTED") for a, b, r in rows], "source string, target string, relation string, confidence string"))


@pytest.fixture(scope="module")
def refunds(spark):
    n = make_nodes(spark, [("api", "ApiHandler", "function"), ("service", "RefundService", "class"), ("db", "refunds_table", "table"), ("worker", "RetryWorker", "function"), ("orphan", "Orphan", "function")])
    e = make_edges(spark, [("api", "service", "calls"), ("service", "db", "references"), ("worker", "service", "calls")])
    return n.cache(), e.cache()


def test_path(refunds):
    _, e = refunds
    assert [s.target for s in traverse.shortest_path(e, "api", "db")] == ["service", "db"]
    assert [s.direction for s in traverse.shortest_path(e, "db", "api")] == ["<-", "<-"]
    assert traverse.shortest_path(e, "api", "api") == []
    with pytest.raises(traverse.NoPath):
        traverse.shortest_path(e, "api", "orphan")


def test_affected(refunds):
    n, e = refunds
    assert [(r.id, r.depth) for r in traverse.affected(n, e, "db").orderBy("depth", "place").collect()] == [("service", 1), ("api", 2), ("worker", 2)]
    assert traverse.affected(n, e, "db", relations=("calls",)).count() == 0
    assert traverse.affected(n, e, "db", depth=1).count() == 1


def test_explain_hubs_card(refunds):
    n, e = refunds
    assert {(r.dir, r.relation): r.ids for r in cards.explain(e, "service").collect()} == {("out", "references"): ["db"], ("in", "calls"): ["api", "worker"]}
    top = cards.hubs(n, e).collect()
    assert len(top) == 4 and (top[0].id, top[0].n_in, top[0].n_out) == ("service", 2, 1)
    c = cards.card(n, e, "service").first()
    assert c.called_by == ["api", "worker"] and c.other == ["references → db"] and c.parent is None


@pytest.mark.parametrize("name", ["acme::billing::RefundService", "acme.billing.RefundService", "src/billing/RefundService", "refundservice", "service"])
def test_resolve(refunds, name):
    assert resolve.resolve(refunds[0], name).node.id == "service"


def test_resolve_misses(spark, refunds):
    with pytest.raises(resolve.NoNode) as e:
        resolve.resolve(refunds[0], "RefndServce")
    assert "RefundService" in e.value.suggestions
    with pytest.raises(resolve.NoNode) as e:
        resolve.resolve(refunds[0], "qqqqqq")
    assert e.value.suggestions == []
    n = make_nodes(spark, [("a", "PayInvoiceRetry", "function"), ("b", "PayInvoiceOnce", "function")])
    with pytest.raises(resolve.Ambiguous) as e:
        resolve.resolve(n, "PayInvoice")
    assert {c.label for c in e.value.candidates} == {"PayInvoiceOnce", "PayInvoiceRetry"}
    assert resolve.resolve(n.where("id = 'a'"), "PayInvoice").via == "fuzzy"
    stub = make_nodes(spark, [("module://url_for", "url_for", "module"), ("z::url_for", "url_for", "function")])
    assert resolve.resolve(stub, "url_for").node.id == "z::url_for"


def test_many_twins_are_ambiguous(spark):
    n = make_nodes(spark, [(f"t{i:03}", "read file", "function") for i in range(250)] + [("z", "file read", "function")])
    with pytest.raises(resolve.Ambiguous):
        resolve.resolve(n, "read file now")
    assert resolve.resolve(n.where("id <> 'z'"), "read file now").node.id == "t000"


def test_long_path(spark):
    e = make_edges(spark, [(f"n{i:03}", f"n{i + 1:03}", "calls") for i in range(12)])
    assert len(traverse.shortest_path(e, "n000", "n012")) == 12
    with pytest.raises(traverse.NoPath):
        traverse.shortest_path(e, "n000", "n012", max_depth=5)


def test_body_head_counts_bytes(spark):
    from graphloom.functions.text import body_head

    r = spark.range(1).select(body_head(F.lit("é" * 10 + "\nx\ny"), 2, 8).alias("b"), body_head(F.lit("é" * 3), 2, 5).alias("c")).first()
    assert r.b == "éééé\n… 1 more" and r.c.startswith("éé") and "é" * 3 != r.c


def test_tokens(spark):
    r = spark.range(1).select(tokens(F.lit("HTTPServer blkMqSubmitBio parseURL x")).alias("t"), trigrams(F.lit("ab")).alias("g")).first()
    assert r.t == ["http", "server", "blk", "mq", "submit", "bio", "parse", "url"] and r.g == []


def test_search(spark):
    n = make_nodes(spark, [("1", "BlkMqSubmitBio", "function"), ("2", "ElvRegister", "function"), ("3", "README.md", "document")])
    e = make_edges(spark, [("1", "2", "calls")])
    hits = search.search(n, e, "where is submit bio handled").collect()
    assert hits[0].id == "1" and [(x.id, x.dir) for x in hits[0].neighbors] == [("2", "out")]
    typo = make_nodes(spark, [("1", "RefundSerializer", "class"), ("2", "PaymentGateway", "class")])
    assert search.search(typo, e.where("false"), "refund serialzer").first().id == "1"
    many = make_nodes(spark, [(f"n{i:03d}", f"SubmitHandler{i}", "function") for i in range(500)])
    kept = search.search(many, e.where("false"), "submit handler", budget=200).collect()
    assert 1 <= len(kept) <= 20 and kept[0].id == "n000"


def test_search_intents(spark):
    n = make_nodes(spark, [("module://url_for", "url_for", "module", "module://url_for"), ("h::url_for", "url_for", "function", "helpers.py"), ("t::url_for", "url_for", "function", "tests/test_helpers.py")])
    e = make_edges(spark, [])
    first = lambda q: [r.id for r in search.search(n, e, q).collect()]
    assert first("where is url_for defined")[0] == "h::url_for"
    assert "module://url_for" in first("which files import url_for")[:2]
    assert first("url_for tests")[0] == "t::url_for"


def test_test_paths(spark):
    yes = ["tests/a.py", "src/test/A.java", "pkg/test_a.py", "a_test.go", "x.spec.ts", "x.test.js", "src/FooTest.java", "FooTests.cs"]
    no = ["src/attest.cs", "contest.go", "latest/a.py", "src/Test.go", "a.py", ""]
    df = spark.createDataFrame([(p,) for p in yes + no], "p string").where(is_test_path("p"))
    assert {r.p for r in df.collect()} == set(yes)


def test_filters(spark):
    n = make_nodes(spark, [("dep:npm/vitest", "vitest", "dependency", "dep://", {"scopes": "dev", "producer": "manifests"}), ("dep:npm/react", "react", "dependency", "dep://", {"scopes": "runtime"}), ("k8s://prod/service/api", "service/api", "service", "k", {"namespace": "prod"}), ("src/app.tsx", "app.tsx", "file", "src/app.tsx"), ("src/app.tsx::App", "App", "function")])
    e = make_edges(spark, [("src/app.tsx", "module://react", "imports"), ("module://react", "dep:npm/react", "resolves_to"), ("a", "b", "calls")])
    ids = lambda **f: {r.id for r in n.where(filters.Predicate.parse(f).on_nodes()).collect()}
    assert ids(kind="dependency", scope="dev") == {"dep:npm/vitest"}
    assert ids(kind="service,file") == {"k8s://prod/service/api", "src/app.tsx"}
    assert ids(where="namespace=prod") == {"k8s://prod/service/api"}
    assert ids(where="id~app.tsx") == {"src/app.tsx", "src/app.tsx::App"}
    assert ids(where="nope=1") == set()
    assert e.where(filters.Predicate.parse({"id-prefix": "dep:"}).on_edges()).count() == 1
    assert ids(**{"id-prefix": "dep:"}) == {"dep:npm/vitest", "dep:npm/react"} and ids(producer="manifests") == {"dep:npm/vitest"}
    assert filters.Predicate(relation=("resolves_to",)).apply(n, e)[0].count() == 5
    with pytest.raises(ValueError):
        filters.Condition.parse("nonsense")


def batch(spark, name, ids, label="x"):
    return Batch(name, make_nodes(spark, [(i, label, "k") for i in ids]), make_edges(spark, []))


def test_quarantine(spark):
    n = make_nodes(spark, [(f"n{i}", "x", "k") for i in range(100)] + [("bad", "", "k"), ("n1", "y", "k")])
    e = make_edges(spark, [("n1", "bad", "calls"), ("n1", "elsewhere", "calls")])
    p = mutate.partition(Batch("a", n, e))
    assert p.nodes.count() == 100 and [r.target for r in p.edges.collect()] == ["elsewhere"]
    assert {(r.id, r.reason) for r in p.quarantine.collect()} == {("bad", "label is required"), ("n1->bad", "dangling: endpoint quarantined this batch"), ("n1", "duplicate id in batch")}
    for broken in (Batch(" ", n, e), Batch("a", n, e)):
        with pytest.raises(mutate.Rejected):
            mutate.validate(broken)


def test_replace_and_merge(spark):
    n, e = mutate.merge(*(lambda b: (b.nodes.where("false"), b.edges))(batch(spark, "A", [])), batch(spark, "A", ["a1", "a2", "a3", "a4"]))
    n, e = mutate.merge(n, e, batch(spark, "B", ["b1"]))
    done = mutate.replace(n, e, batch(spark, "A", ["a1", "a2", "a5"]))
    assert (done.added, done.pruned) == (1, 2) and {r.id for r in done.nodes.collect()} == {"a1", "a2", "a5", "b1"}
    with pytest.raises(mutate.Rejected):
        mutate.replace(done.nodes, done.edges, batch(spark, "A", ["a1"]))
    assert mutate.replace(done.nodes, done.edges, batch(spark, "A", ["a1"]), force=True).nodes.count() == 2
    merged, _ = mutate.merge(done.nodes, done.edges, batch(spark, "B", ["a1"], "new"))
    assert {(r.label, r.metadata["producer"]) for r in merged.where("id = 'a1'").collect()} == {("new", "A")}
    other = mutate.replace(done.nodes, done.edges, batch(spark, "B", ["b1", "a1"]))
    assert other.nodes.where("id = 'a1'").first().metadata["producer"] == "B"
    n2, _ = mutate.merge_stores([("s1", done.nodes, e), ("s2", batch(spark, "C", ["a1"], "later").nodes, e)])
    assert {(r.label, r.metadata["producer"]) for r in n2.where("id = 'a1'").collect()} == {("later", "A")}
    f, _ = mutate.federate([("m", *(make_nodes(spark, [("dep:npm/x", "x", "dependency"), ("p", "p", "file", "p")]), e))])
    assert {r.id for r in f.collect()} == {"dep:npm/x", "m/p"}


def test_imports(spark):
    specs = ["react", "react-dom/client", "@testing-library/react", "@scope/pkg/deep/sub", "node:fs", "fs", "./local", "left-pad", "github.com/n/nats.go/jetstream", "github.com/me/own/x", "fmt", "org.apache.kafka.clients.KafkaProducer", "com.shared.util.Thing", "@no/where/x"]
    imports = spark.createDataFrame([(f"module://{s}", s) for s in specs], "module_id string, spec string")
    deps = spark.createDataFrame([("n1", "npm", "react"), ("n2", "npm", "react-dom"), ("n3", "npm", "@testing-library/react"), ("n4", "npm", "@scope/pkg"), ("g1", "go", "github.com/n/nats.go"), ("g2", "go", "github.com/me"), ("m1", "maven", "org.apache.kafka:kafka-clients"), ("m2", "maven", "com.shared:lib-a"), ("m3", "maven", "com.shared:lib-b")], "dep_id string, ecosystem string, name string")
    met = links.resolve_imports(imports, deps, spark.createDataFrame([("github.com/me/own",)], "path string"))
    assert {r.spec: r.dep_id for r in met.collect()} == {"react": "n1", "react-dom/client": "n2", "@testing-library/react": "n3", "@scope/pkg/deep/sub": "n4", "github.com/n/nats.go/jetstream": "g1", "org.apache.kafka.clients.KafkaProducer": "m1"}
    assert [r.package for r in links.undeclared(imports, met).collect()] == ["@no/where"]


def test_calls(spark):
    decl = spark.createDataFrame([("a::f", "a", "f"), ("b::f", "b", "f"), ("b::g", "b", "g"), ("c::h", "c", "h"), ("c::h2", "c", "h")], "id string, file string, name string")
    calls = spark.createDataFrame([("a::x", "a", "f"), ("a::x", "a", "g"), ("z::x", "z", "f"), ("c::x", "c", "h"), ("b::g", "b", "g")], "caller string, file string, name string")
    assert {(r.caller, r.callee) for r in links.resolve_calls(calls, decl).collect()} == {("a::x", "a::f"), ("a::x", "b::g")}


def test_cochange(spark):
    many = [("big", f"f{i}.go") for i in range(23)]
    files = spark.createDataFrame([("c1", "a.go"), ("c1", "a_test.go"), ("c1", "b.go"), ("c2", "a.go"), ("c2", "a_test.go"), ("c3", "a.go"), ("c3", "a_test.go"), ("c4", "a.go"), ("s", "a.go"), ("s", "a_test.go"), ("m", "a.go"), ("m", "b.go"), *many], "commit_id string, path string")
    commits = spark.createDataFrame([(c, i, c == "m") for i, c in enumerate(["c1", "c2", "c3", "c4", "s", "m", "big"])], "commit_id string, seq int, is_merge boolean")
    assert [tuple(r) for r in history.cochanges(commits, files).collect()] == [("a.go", "a_test.go", 4, "0.80")]
    # Commits of many files don't count, though few of them are live; names of secrets go.
    wide = [(f"w{c}", f) for c in range(3) for f in ("x.go", "y.go", *(f"gone{i}" for i in range(28)))]
    hidden = [(f"h{c}", f) for c in range(3) for f in ("p.go", "my_secrets.txt")]
    both = spark.createDataFrame(wide + hidden, "commit_id string, path string")
    seqs = both.select("commit_id", F.lit(1).alias("seq"), F.lit(False).alias("is_merge")).distinct()
    assert history.cochanges(seqs, both, both.where("path like '%.go' or path like '%.txt'").select("path").distinct()).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_communities(spark, parts):
    rows = [(f"{c}{i}", f"{c}{i}()", "function", f"internal/{d}/x.go") for c, d in (("a", "alpha"), ("b", "beta")) for i in range(5)]
    n = make_nodes(spark, [*rows, ("bridge", "bridge", "function", "internal/x/b.go"), ("orphan", "orphan", "function")]).repartition(parts)
    inner = [(f"{c}{i}", f"{c}{j}", "calls") for c in "ab" for i in range(5) for j in range(i + 1, 5)]
    e = make_edges(spark, [*inner, ("bridge", "a0", "calls"), ("bridge", "b0", "calls")]).repartition(parts)
    found = communities.communities(n, e).collect()
    assert [r.size for r in found] == [6, 5] and found[0].community == "a0() (internal/alpha)" and found[1].members == [f"b{i}" for i in range(5)]
    assert communities.communities(n, e, method="lpa").first().size == 11
    # Two pairs that nothing joins are both left out.
    apart = make_edges(spark, [("a0", "a1", "calls"), ("b0", "b1", "calls")])
    assert communities.communities(n, apart).count() == 0 and communities.communities(n, e.unionByName(apart.where("false"))).count() == 2


def test_feedback_and_usage(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    shape = "question string, correction string, nodes array<string>, outcome string, `when` timestamp"
    from datetime import datetime

    old, new = datetime(2024, 1, 2), datetime(2024, 2, 1)
    r = spark.createDataFrame([("q", "", ["n1"], "useful", old), ("q", "fix", ["n1"], "corrected", new), ("q", "no correction", ["n2"], "dead_end", new)], shape)
    assert {x.node: round(x.score, 9) for x in records.feedback_scores(r, now).collect()} == {"n1": -0.5, "n2": -1.0}
    preferred, dead, fixes = records.lessons(r, now)
    assert preferred.count() == 0 and [x.node for x in dead.collect()] == ["n2", "n1"] and [x.correction for x in fixes.collect()] == ["fix"]
    u = spark.createDataFrame([(new, "query", 2000), (new, "card", 1500), (datetime(2024, 1, 2), "query", 400)], "ts timestamp, verb string, bytes long")
    s = records.usage_summary(u, now).first()
    assert (s.total, s.today, s.last_7_days, s.est_tokens) == (3, 2, 2, 975)


def test_records(spark):
    src = spark.createDataFrame([("a", "h", 1, "h", 1), ("b", "h", 10, "i", 25), ("c", None, 0, "h", 1)], "path string, head string, head_unix long, current string, current_unix long")
    f = records.freshness(src)
    assert {r.path: (r.state, r.behind) for r in f.collect()} == {"a": ("fresh", 0), "b": ("stale", 15), "c": ("unknown", 0)}
    assert tuple(records.overall(f).first()) == ("stale", 1) and tuple(records.overall(f.where("false")).first()) == ("unknown", 2)
    n = make_nodes(spark, [("x", "Thing", "class", "a.go"), ("y", "Gone", "class", "b.go")]).withColumn("location", F.when(F.col("id") == "x", "L1-L9").otherwise("L1"))
    claims = spark.createDataFrame([(c,) for c in ("x", "thing", "nope", "a.go:L3-L4", "a.go:L50", "y", "d.go:L1")], "claim string")
    files = spark.createDataFrame([("a.go", 10, False), ("d.go", 5, True)], "path string, lines int, changed boolean")
    assert {r.claim: r.verdict for r in records.verify(claims, n, files).collect()} == {"x": "ok", "thing": "ok", "nope": "missing-node", "a.go:L3-L4": "ok", "a.go:L50": "out-of-range", "y": "missing-file", "d.go:L1": "drifted"}
    due = spark.createDataFrame([("a", 0), ("b", None), ("c", 99_000)], "id string, captured_unix long")
    assert {r.id for r in records.due(due, 100_000).collect()} == {"a", "b"}


def test_scalars(spark):
    r = spark.range(1).select(round2(F.lit(1.005)).alias("r"), scope_class(F.lit("testImplementation")).alias("t"), scope_class(F.lit("devDependencies")).alias("d"), scope_class(F.lit("x")).alias("x")).first()
    assert (r.r, r.t, r.d, r.x) == (1.0, "test", "dev", None)


def test_plan_and_view(refunds):
    n, e = refunds
    plan = cards.change_plan(n, e, "db")
    assert [r.id for r in plan.impacts.orderBy("depth", "place").collect()] == ["service", "api", "worker"]
    assert plan.tests.count() == 0 and plan.confidence.first()["count"] == 3
    shown, inside = cards.viewer_payload(n, e, limit=2)
    assert shown.count() == 2 and inside.count() == 1
    assert {r.id for r in cards.viewer_payload(n, e, center="service")[0].collect()} == {"api", "db", "service", "worker"}


def test_path_length_without_a_path(spark, monkeypatch):
    from graphloom.plans import queries

    chain = lambda n: [("customer:1", "x0", "in_nation"), *((f"x{i}", f"x{i + 1}", "in_region") for i in range(n)), (f"x{n}", "nation:14", "in_region")]
    found = []
    for rows in ([("customer:1", "nation:2", "in_nation"), ("nation:14", "region:1", "in_region")], chain(4), chain(5)):
        monkeypatch.setattr(queries, "walked", lambda spark, sf, rows=rows: (None, make_edges(spark, rows)))
        found.append(queries.shortest_path_length(spark, "").first().steps)
    assert found == [None, 6, None]


def test_path_from_both_ends(spark):
    """On random graphs the walk is the one that a plain first-in-first-out walk finds, and few edges are looked at again."""
    import random

    def plain(rows, start, goal):
        both = [(a, b, 0, r) for a, b, r in rows] + [(b, a, 1, r) for a, b, r in rows]
        order, seen, came = [start], {start}, {}
        while order and goal not in seen:
            place = {x: i for i, x in enumerate(order)}
            best = {}
            for a, b, back, r in both:
                if a in place and b not in seen:
                    best[b] = min(best.get(b, (10**9,)), (place[a], back, r, a))
            came |= best
            order = sorted(best, key=lambda b: (best[b][0], b))
            seen |= set(order)
        steps, at = [], goal
        while at != start and goal in seen:
            _, back, r, a = came[at]
            steps.append((a, at, r, "<-" if back else "->"))
            at = a
        return steps[::-1]

    rng = random.Random(5)
    for _ in range(2):
        rows = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.choice("xyz")) for _ in range(34)]
        want = plain(rows, "n1", "n2")
        try:
            found = [(s.source, s.target, s.relation, s.direction) for s in traverse.shortest_path(make_edges(spark, rows), "n1", "n2")]
        except traverse.NoPath:
            found = []
        assert found == want
    # A hub next to the start is not walked through: the goal's side is smaller.
    star = [("s", "hub", "x"), ("hub", "t", "x"), *(("hub", f"n{i}", "x") for i in range(50))]
    fronts = []
    old, traverse._Front.go_on = traverse._Front.go_on, lambda self: (old(self), fronts.append(self.size))[0]
    try:
        assert len(traverse.shortest_path(make_edges(spark, star), "s", "t")) == 2
    finally:
        traverse._Front.go_on = old
    assert max(fronts) == 1


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_modules_are_joined_where_paths_are(spark):
    paths = spark.createDataFrame([(p, i) for i, p in enumerate(("a", "a/b", "a/b/c", "a/b/c/d.py", "ab/x", "", None, "a/b", "z"))], "path string, k int")
    modules = spark.createDataFrame([("top", "a"), ("deep", "a/b/c"), ("none", None), ("z1", "z"), ("z2", "z")], "name string, path string")
    found = links.module_of(paths, modules)
    assert found.columns == ["path", "k", "module"]
    assert [r.module for r in found.orderBy("k").collect()] == ["top", "top", "deep", "deep", None, None, None, "top", "z2"]
    assert "SortAggregate" not in _plan(found) and "SortMergeJoin" not in _plan(found)


def test_selectors_are_joined_on_all_pairs(spark):
    services = spark.createDataFrame([("s1", "n", {"a": "1", "b": "2"}), ("s2", "n", {"b": "2"}), ("s3", "m", {"a": "1"}), ("s4", "n", {}), ("s5", "n", {"c": None})], "id string, namespace string, selector map<string,string>")
    work = spark.createDataFrame([("w1", "n", {"a": "1", "b": "2", "c": "3"}), ("w2", "n", {"b": "2"}), ("w3", "n", {"a": "1"}), ("w4", "m", {"a": "1", "c": None}), ("w5", "n", {"c": None})], "id string, namespace string, labels map<string,string>")
    found = links.select_workloads(services, work)
    assert {tuple(r) for r in found.collect()} == {("s1", "w1"), ("s2", "w1"), ("s2", "w2"), ("s3", "w4")}
    # One pair of a selector, that very many workloads may have, is no key of the join.
    assert "explode(labels" not in _plan(found) and "values" in _plan(found)


def test_degrees_are_dealt_by_size(spark, tmp_path, monkeypatch):
    from graphloom.functions import tables

    spark.range(20_000).selectExpr("concat('a', id) as source", "concat('b', id % 7) as target").write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    monkeypatch.setattr(tables, "PART_BYTES", 4 << 10)
    many = cards.degrees(e)
    assert many.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert many.agg(F.sum("n_in"), F.sum("n_out"), F.count("*")).first() == (20_000, 20_000, 20_007)


def test_tokens_that_may_match(spark):
    """No token that a tier takes is left out, and few others stay; a question's texts are taken apart once."""
    asked = ["widgett", "smal", "re"]
    words = ["widget", "widgett", "wi", "w", "s", "small", "smalls", "sm", "red", "re", "r", "idg", "gadget", "123456", "blue", "all"]
    kept = {r.t for r in spark.createDataFrame([(w,) for w in words], "t string").where(search.may_match(F.col("t"), asked)).collect()}
    assert {"widget", "widgett", "wi", "w", "s", "small", "smalls", "sm", "re", "r"} <= kept and not {"123456", "blue", "red"} & kept
    n = make_nodes(spark, [("1", "red widget", "part"), ("2", "widgets small", "part"), ("3", "blue ring", "part"), ("4", "red.ring", "part")])
    e = make_edges(spark, [("1", "2", "x")])
    given = search.search(n, e, "red widget smal", post=search.postings(n)).collect()
    assert [r.asDict() for r in search.search(n, e, "red widget smal").collect()] == [r.asDict() for r in given] and len(given) == 3


def test_merge_joins_once(spark):
    old_n, old_e = batch(spark, "A", ["a", "b"]).nodes, make_edges(spark, [("a", "b", "x"), ("b", "a", "x")])
    old_n, old_e = (df.withColumn("metadata", F.create_map(F.lit("producer"), F.lit("A"), F.lit("k"), F.lit("old"))) for df in (old_n, old_e))
    new = Batch("B", batch(spark, "B", ["b", "c"], "new").nodes, make_edges(spark, [("b", "a", "x"), ("b", "c", "x"), ("b", "c", "x")]))
    n, e = mutate.merge(old_n, old_e, new)
    assert {(r.id, r.label, r.metadata["producer"], r.metadata.get("k")) for r in n.collect()} == {("a", "x", "A", "old"), ("b", "new", "A", None), ("c", "new", "B", None)}
    assert sorted((r.source, r.target, r.metadata["producer"]) for r in e.collect()) == [("a", "b", "A"), ("b", "a", "A"), ("b", "c", "B")]
    assert _plan(e).split("== Initial Plan")[0].count("Join ") == 1


def test_communities_hold_arrays():
    """Some 170 bytes a node rather than many objects; small communities join the strongest neighbour, lone ones are left out."""
    import tracemalloc

    import numpy as np

    n = 60_000
    a, b = np.arange(n - 24), n - 24 + np.arange(n - 24) % 24
    tracemalloc.start()
    own = communities.partition(n, a, b, np.ones(n - 24))
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
    assert len(set(own.tolist())) == 24 and (own[a] == own[b]).all()
    pairs = [(i, j, 1.0) for c in (0, 6) for i in range(c, c + 6) for j in range(i + 1, c + 6)] + [(0, 12, 0.5), (6, 12, 2.0), (13, 14, 1.0)]
    own = communities.partition(16, *(np.array(x) for x in zip(*pairs))).tolist()
    assert own[12] == own[6] != own[0] and own[13:] == [-1, -1, -1] and len(set(own)) == 3
