"""Files, connectors, the store, exports, streams."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions.schema import Batch
from graphloom.sources import adapters, catalog, connect, export, extract, yaml_lines
from graphloom.sources.store import Store, read_batch, read_ndjson, tree_signature
from graphloom.streaming import logs

from .test_graph import batch, make_edges, make_nodes

DEPLOY = """apiVersion: apps/v1
kind: Deployment
metadata:
  name: api
  namespace: prod
spec:
  template:
    metadata:
      labels:
        app: api
        tier: web
    spec:
      containers:
        - name: api
          image: registry/api:1
          envFrom:
            - configMapRef:
                name: settings
---
apiVersion: v1
kind: Service
metadata:
  name: api
  namespace: prod
spec:
  selector:
    app: api
---
apiVersion: networking.k8s.io/v1
kind: Ingress
metadata:
  name: web
  namespace: prod
spec:
  rules:
    - http:
        paths:
          - path: /v1
            backend:
              service:
                name: api
"""

FILES = {
    "README.md": "# Title\nsee [[Other]]\n## Part\n[doc](docs/a.md)\n## Part\ntext\n# End\n",
    "package.json": json.dumps({"dependencies": {"react": "^18"}, "devDependencies": {"vitest": "1"}, "scripts": {"build": "x"}, "workspaces": ["ui"]}),
    "pom.xml": "<project xmlns='http://maven'><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency></dependencies></project>",
    "build.gradle": "dependencies {\n  implementation 'g:b:2'\n  api(\"g:c:$v\")\n}\n",
    "go.mod": "module m\nrequire (\n  x.org/y v1.0.0 // indirect\n)\nrequire z.org/w v2\n",
    "App.csproj": '<Project><ItemGroup><PackageReference Include="Newtonsoft.Json" Version="13"/><ProjectReference Include="..\\B\\B.csproj"/></ItemGroup></Project>',
    "Makefile": "run: build\n\tgo run\nlint:\n\tx\nA := 1\n",
    "Taskfile.yml": "version: 3\ntasks:\n  build:\n    cmds:\n      - go build\n  test:\n    desc: t\n",
    "deploy.yaml": DEPLOY,
    "api.yaml": "openapi: 3.0.0\npaths:\n  /a:\n    get:\n      summary: x\n",
    "svc/main.py": "import react\nfrom fastapi import FastAPI\napp = FastAPI()\n\n@app.get('/items')\ndef items():\n    'List.'\n    return helper()\n\nclass A:\n    def run(self):\n        return helper()\n",
    "svc/util.py": "def helper():\n    return 1\n",
    "bad/package.json": "{",
}


@pytest.fixture(scope="module")
def gathered(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    found = extract.batches(files)
    return {b.producer: ({r.id: r for r in b.nodes.collect()}, {(r.source, r.target, r.relation): r for r in b.edges.collect()}) for b in found}, found


def test_markdown(gathered):
    n, e = gathered[0]["markdown"]
    assert n["README.md::title"].location == "L1-L6" and n["README.md::part"].location == "L3-L4" and n["README.md::part-2"].location == "L5-L6"
    assert ("README.md::title", "README.md::part-2", "contains") in e and ("README.md::part", "docs/a.md", "references") in e
    assert e["README.md::title", "Other", "references"].confidence == "INFERRED"
    assert "api.yaml::route:GET /a" in n and "deploy.yaml::route:ANY /v1" in n and n["Makefile#run"].file_type == "config"


def test_manifests(gathered):
    n, e = gathered[0]["manifests"]
    scope = lambda a, b: e[a, b, "declares"].metadata.get("scope_class")
    assert scope("package.json", "dep:npm/vitest") == "dev" and scope("pom.xml", "dep:maven/g:a") == "test"
    assert scope("build.gradle", "dep:maven/g:b") == "runtime" and "dep:maven/g:c" not in n
    assert scope("go.mod", "dep:go/x.org/y") == "indirect" and scope("go.mod", "dep:go/z.org/w") == "runtime"
    assert ("App.csproj", "dep:nuget/Newtonsoft.Json", "declares") in e and ("App.csproj", "../B/B.csproj", "depends_on") in e
    assert {"package.json::task:build", "Makefile::task:run", "Makefile::task:lint", "Taskfile.yml::task:build", "Taskfile.yml::task:test"} <= set(n)
    assert not any(k.startswith("Makefile::task:A") for k in n)


def test_kubernetes(gathered):
    n, e = gathered[0]["manifests"]
    assert n["k8s://prod/deployment/api"].label == "deployment/api"
    for want in (("k8s://prod/service/api", "k8s://prod/deployment/api", "selects"), ("k8s://prod/ingress/web", "k8s://prod/service/api", "routes_to"), ("k8s://prod/deployment/api", "k8s://prod/configmap/settings", "mounts"), ("k8s://prod/deployment/api", "image:registry/api:1", "uses_image")):
        assert want in e


def test_python(gathered):
    n, e = gathered[0]["code"]
    assert n["svc/main.py::A.run"].kind == "method" and n["svc/main.py::items"].metadata["doc"] == "List."
    assert e["svc/main.py::items", "svc/util.py::helper", "calls"].confidence == "INFERRED"
    assert ("svc/main.py", "module://react", "imports") in e and ("svc/main.py::route:GET /items", "svc/main.py::items", "handles") in e


def test_dependency_links(spark, gathered):
    all_n = [b.nodes for b in gathered[1]]
    all_e = [b.edges for b in gathered[1]]
    n, e = all_n[0].unionByName(all_n[1]).unionByName(all_n[2]), all_e[0].unionByName(all_e[1]).unionByName(all_e[2])
    met = extract.dependency_links(n, e, spark.createDataFrame([], "path string"))
    assert [(r.source, r.target) for r in met.collect()] == [("module://react", "dep:npm/react")]


def test_read_files(spark, tmp_path):
    for p, c in (("a.md", "# A"), ("node_modules/x.md", "# X"), (".env.md", "s"), ("b/min.js", "x" * 60_000), ("b/go.mod", "module m"), ("skip/c.md", "# C"), ("package-lock.json", "{}"), ("secret_scan.py", "x = 1"), ("my-secrets.yaml", "a: 1")):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text(c)
    ignored = spark.createDataFrame([("skip",)], "path string")
    files = extract.read_files(spark, str(tmp_path), ignored)
    assert {r.path for r in files.collect()} == {"a.md", "b/go.mod", "secret_scan.py"}
    assert [tuple(r) for r in extract.scan_modules(files).collect()] == [("b", "go.mod")]
    assert tree_signature(spark, str(tmp_path)).files == 8  # hidden files are not listed


def test_yaml_lines():
    found = list(yaml_lines.lines("a:\n  - b: 1\n    c: 'x: y' \n  - d\ne: |\n  text: no\nf: z # note\n"))
    assert [(x.path, x.value) for x in found] == [(("a",), ""), (("a", "[0]", "b"), "1"), (("a", "[0]", "c"), "x: y"), (("a", "[1]"), "d"), (("e",), ""), (("f",), "z")]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.nodes().count() == 0
    s.merge(batch(spark, "A", ["a1", "a2"]))
    s.replace(batch(spark, "source:X", ["x1"]))
    assert s.current() == 2 and {r.id for r in s.nodes().collect()} == {"a1", "a2", "x1"} and s.manifest().count() >= 2
    assert s.prune_orphans(spark.createDataFrame([], "producer string")) == ["source:X"] and s.nodes().count() == 2


def test_store_records(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.sources() == [] and s.stamps() == {} and s.lanes("/r", "h", "t") == {"files", "history"}
    s.record_source("/r", "h", 1, 2, "t")
    s.record_source("/q", "i")
    s.record_source("/r", "h", 1, 3, "t2")
    assert [(r["path"], r["added_unix"]) for r in s.sources()] == [("/q", 0), ("/r", 3)]
    assert s.lanes("/r", "h", "t2") == set() and s.lanes("/r", "h", "t3") == {"files"} and s.lanes("/r", "g", "t3") == {"files", "history"} and s.lanes("/r", "h", "t2", force=True) == {"files", "history"}
    s.record_stamp("b", 5)
    s.record_stamp("a", 6)
    s.remove_stamps(["b", "c"])
    assert s.stamps() == {"a": 6}
    # A snapshot number that another writer holds is not used.
    s.write(*(lambda b: (b.nodes, b.edges))(batch(spark, "A", ["a1"])))
    (tmp_path / "store" / ".claim-2").write_text("")
    assert s.write(s.nodes(), s.edges()) == 3 and s.nodes().count() == 1 and s.current() == 3


def test_adapters(spark, tmp_path):
    doc = json.dumps({"nodes": [{"id": "x", "label": "x", "kind": "k", "file_type": "f", "source": "s"}], "edges": [{"source": "x", "target": "x", "relation": "r", "confidence": "EXTRACTED"}]})
    adapters.register_adapter("one")(lambda s: adapters.command(s, "one", f"echo '{doc}'", str(tmp_path)))
    s = Store(spark, str(tmp_path / "store"))
    assert adapters.run_adapters(s, "one")["one"].added == 1 and s.nodes().first().metadata["producer"] == "one" and s.edges().count() == 1
    for bad in ("exit 3", "echo nothing"):
        with pytest.raises(adapters.AdapterError):
            adapters.command(spark, "bad", bad, str(tmp_path))
    with pytest.raises(adapters.AdapterError):
        adapters.run_adapters(s, "none")


def test_summaries():
    assert extract.summary_of("<!-- a\nb -->\n[!x]\nLicensed to X\nplain\n## The *Head*\n") == "The *Head*"
    assert extract.summary_of("\n" + "w" * 200) == "w" * 120 and extract.summary_of("") == ""


def test_catalog_details(spark):
    ts = spark.createDataFrame([("public", "o", "table"), ("public", "v", "view")], "schema string, name string, kind string")
    cs = spark.createDataFrame([("public", "o", "c", "int", True, 1)], "schema string, table string, name string, type string, nullable boolean, ordinal int")
    ix = spark.createDataFrame([("public", "o", f"i{k:02}") for k in range(25)], "schema string, table string, name string")
    pt = spark.createDataFrame([("public", "o")] * 3, "schema string, table string")
    vw = spark.createDataFrame([("public", "v", "s" * 500)], "schema string, table string, definition string")
    b = catalog.described(catalog.shape("postgres://h/d", ts, cs), "postgres://h/d", catalog.details(ix, pt, vw))
    m = {r.id: r.metadata for r in b.nodes.collect()}
    assert m["postgres://h/d/public/o"]["index_count"] == "25" and m["postgres://h/d/public/o"]["indexes"].endswith("i19") and m["postgres://h/d/public/o"]["partitions"] == "3"
    assert m["postgres://h/d/public/v"]["definition"] == "s" * 400 + "…" and "pk" in m["postgres://h/d/public/o/c"]


def test_feedback_is_checked(spark, tmp_path):
    shape = "question string, nodes array<string>, outcome string, correction string"
    with pytest.raises(ValueError):
        logs.append_feedback(spark.createDataFrame([("q", ["n"], "corrected", "")], shape), str(tmp_path / "f"))
    with pytest.raises(ValueError):
        logs.append_feedback(spark.createDataFrame([("q", ["n"], "liked", "")], shape), str(tmp_path / "f"))
    logs.append_feedback(spark.createDataFrame([("q", ["n"], "useful", "")], shape), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 1


def test_exports(spark, tmp_path):
    n = make_nodes(spark, [("b", 'B "q"', "class", "b.go", {"producer": "p"}), ("a", "A&A", "function"), ("c", "A&A", "function"), ("module://m", "m", "module")])
    e = make_edges(spark, [("a", "b", "calls"), ("a", "module://m", "imports")])
    lines = lambda df: [r.value for r in df.collect()]
    doc = json.loads("".join(lines(export.json(n, e))))
    assert [x["id"] for x in doc["nodes"]] == ["a", "b", "c", "module://m"] and "weight" not in doc["edges"][0]
    assert len(lines(export.ndjson(n, e))) == 6 and lines(export.dot(n, e))[2] == '  "b" [label="B \\"q\\"\\n(class)"];'
    xml = "\n".join(lines(export.graphml(n, e)))
    assert "A&amp;A" in xml and 'data key="weight"' not in xml
    notes = {r.name: r.body for r in export.notes(n, e).collect()}
    assert set(notes) == {"a-a", "a-a-2", "b-q"} and "- calls [[b-q]]" in notes["a-a"]
    export.write_all(n, e, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv/nodes")).count() == 4
    assert {(r.section, r.name) for r in export.wiki_index(n, e).collect()} >= {("kind", "class"), ("relation", "calls"), ("hub", "a")}
    assert "## calls →" in export.wiki_pages(n, e, n.select("id")).where("id = 'a'").first().body
    export.ndjson(n, e.where("false")).write.text(str(tmp_path / "n"))
    back, _ = read_ndjson(spark, str(tmp_path / "n"), str(tmp_path / "n"))
    assert back.count() == 4
    (tmp_path / "b.json").write_text(json.dumps({"producer": "p", "nodes": [{"id": "x", "label": "x", "kind": "k", "file_type": "f", "source": "s"}], "edges": []}))
    assert read_batch(spark, str(tmp_path / "b.json")).nodes.first().id == "x"


def test_catalog(spark):
    b = catalog.capture("db", {"t": spark.range(1).withColumn("s", F.lit("x"))})
    assert {r.kind for r in b.nodes.collect()} == {"database", "schema", "table", "column"} and b.edges.count() == 4
    foreign = spark.createDataFrame([("fk", "public", "o", "c_id", "public", "c", "id")], "name string, schema string, table string, column string, ref_schema string, ref_table string, ref_column string")
    ts = spark.createDataFrame([("public", "o", "table"), ("public", "c", "table")], "schema string, name string, kind string")
    cs = spark.createDataFrame([("public", "o", "c_id", "int", True, 1)], "schema string, table string, name string, type string, nullable boolean, ordinal int")
    refs = catalog.shape("postgres://h/db", ts, cs, None, foreign).edges.where("relation = 'references'").first()
    assert refs.metadata["constraints"] == "fk(c_id→id)" and refs.target == "postgres://h/db/public/c"


def test_connect(spark, tmp_path):
    assert connect.expand("${A}/x", {"A": "1"}) == "1/x" and connect.expand("A", {"A": "v"}) == "v"
    for bad in ("postgres://u:pw@h/d", "kafka://h?token=abc"):
        with pytest.raises(connect.SourceError):
            connect.refuse_literal_credentials(bad)
    connect.refuse_literal_credentials("postgres://u:$PW@h/d")
    assert connect.sanitized("postgres://u:p@h/d?password=x&a=1") == "postgres://h/d?a=1" and connect.sanitized("https://u@h/p?q=1") == "https://h/p"
    assert connect.connector("mysql://h") == "mysql" and connect.connector("a.json") == "openapi"
    spec = {"openapi": "3.0.0", "info": {"title": "T"}, "paths": {"/a": {"get": {"responses": {"200": {"$ref": "#/components/schemas/S"}}}}}, "components": {"schemas": {"S": {}}}}
    (tmp_path / "api.json").write_text(json.dumps(spec))
    out = connect.run(spark, [str(tmp_path / "api.json"), "redis://h", "$OLD"], {"OLD": 90}, 100, ttl=50, env={})
    assert [o.status for o in out] == ["captured", "failed", "skipped"]
    assert {r.relation for r in out[0].batch.edges.collect()} == {"contains", "uses"}
    with pytest.raises(connect.SourceError):
        connect.strict(out)
    assert connect.key_prefixes([("a:1", "string"), ("a:2", "hash")]) == {"a": (2, "string")}


def test_streams(spark, tmp_path):
    u = spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'query' as verb, '' as arg, 1 as hits, 100L as bytes, 5L as ms union all select timestamp'2024-01-01 11:00:00', 'query', '', 1, 50L, 5L")
    logs.append(u, str(tmp_path / "usage"))
    assert logs.read_log(spark, str(tmp_path / "usage"), logs.USAGE, False).count() == 2
    q = logs.daily_usage(logs.stream_log(spark, str(tmp_path / "usage"), logs.USAGE)).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r)[1:] for r in spark.table("daily").collect()] == [("query", 2, 150)]
    store = Store(spark, str(tmp_path / "s"))
    split = lambda df: (lambda b: (b.nodes, b.edges))(Batch("usage", make_nodes(spark, [("v", "v", "verb")]), make_edges(spark, [])))
    logs.restate(logs.stream_log(spark, str(tmp_path / "usage"), logs.USAGE), store, "usage", split, str(tmp_path / "ck")).awaitTermination()
    assert store.nodes().first().metadata["producer"] == "usage"
    f = spark.sql("select 'q' as question, '' as answer, '' as type, array('n') as nodes, 'useful' as outcome, '' as correction, timestamp'2024-01-01' as `when` union all select 'q', '', '', array('n'), 'dead_end', '', timestamp'2024-01-31'")
    logs.append(f, str(tmp_path / "fb"))
    q = logs.running_scores(logs.stream_log(spark, str(tmp_path / "fb"), logs.FEEDBACK)).writeStream.outputMode("update").format("memory").queryName("scores").trigger(availableNow=True).start()
    q.awaitTermination()
    assert abs(spark.table("scores").first().score + 0.5) < 1e-9


def test_markdown_of_many_sections():
    """Each heading is looked at once: a page of many sections took the square of their number."""
    import random
    import time

    def plain(heads, size):
        for k, (at, level) in enumerate(heads):
            end = next((i - 1 for i, n in heads[k + 1 :] if n <= level), size)
            above = next((j for j in range(k - 1, -1, -1) if heads[j][1] < level and not any(heads[m][1] <= heads[j][1] for m in range(j + 1, k))), None)
            yield f"L{at}-L{end}", above

    rng = random.Random(7)
    levels = [rng.randint(1, 6) for _ in range(200)]
    found = list(extract.markdown("a.md", "\n".join("#" * n + f" h{k}\nx" for k, n in enumerate(levels))))
    nodes, up = [r for r in found if r.get("kind") == "section"], {r["target"]: r["source"] for r in found if r.get("relation") == "contains"}
    want = list(plain([(2 * k + 1, n) for k, n in enumerate(levels)], 2 * len(levels)))
    assert [(n["location"], up[n["id"]]) for n in nodes] == [(at, "a.md" if j is None else nodes[j]["id"]) for at, j in want]
    began = time.process_time()
    assert sum(1 for _ in extract.markdown("a.md", "# All\n" + "## s\nx\n" * 30_000)) == 1 + 2 * 30_001
    assert time.process_time() - began < 10


ODD = 'import a\nX = """\ndef no(): pass\nclass No: pass\n"""\n@app.get(\'/x\')\ndef f(\na,\n):\n    "D."\n    return g(a)\nif X:\n    f(1)\nelse:\n    g(2)\ntry:\n    f(3)\nexcept E:\n    pass\nfinally:\n    h()\ny = 1 + \\\nf(4)\r\nclass A:\r    def m(self):\n        return f(5)\n'


def test_python_in_parts(monkeypatch):
    """Files parsed in parts give the rows of files parsed whole; strings, brackets and branches go over borders."""
    import ast
    import glob

    texts = [ODD, ODD * 3, "", "\n\n", *(open(f).read() for f in sorted(glob.glob(f"{ast.__file__.rpartition('/')[0]}/[a-d]*.py"))[:25])]
    monkeypatch.setattr(extract, "PYTHON_LINES", 10**9)
    want = [list(extract.python_source("m.py", t)) for t in texts]
    assert [r["location"] for r in want[0] if r.get("kind") in ("function", "class", "method")] == ["L7-L11", "L24-L26", "L25-L26"]
    for size in (1, 7, 90):
        monkeypatch.setattr(extract, "PYTHON_LINES", size)
        assert [list(extract.python_source("m.py", t)) for t in texts] == want
        assert len(extract.python_parts(ODD * 9)) > 1
    for bad in ("def f():\n    pass\n" * 9 + "else:\n    pass\n", "x = 1\n" * 9 + '"""\n', "x = 1\nx = (\n" + "y = 1\n" * 9):
        assert [r["row"] for r in extract.python_source("m.py", bad)] == ["node"]


def test_few_rows_are_held(spark, monkeypatch):
    """A parser's rows wait outside the memory; of one that fails late there are none."""
    import re
    import tracemalloc

    long = lambda n: ({"row": "node", "id": f"{i:06}" + "x" * 500, "metadata": {}} for i in range(n))
    tracemalloc.start()
    assert sum(1 for _ in extract.whole(long(40_000))) == 40_000
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    assert [r["id"][:6] for r in extract.whole(long(4_500))] == [f"{i:06}" for i in range(4_500)]

    def late(path, text):
        yield from (extract.node(f"{path}{i}", "x", "k", "f", path) for i in range(5_000))
        if text == "bad":
            raise ValueError

    monkeypatch.setattr(extract, "_PARSERS", [(re.compile("odd$"), "odd", late)])
    files = spark.createDataFrame([("a.odd", "good"), ("b.odd", "bad"), ("c.odd", None), ("d", "x")], "path string, content string")
    assert {(r.source, r["count"]) for r in extract.rows(files).groupBy("source").count().collect()} == {("a.odd", 5_000), ("c.odd", 5_000)}


def test_yaml_of_many_documents():
    """A file's documents are read one after another, without a list of its lines."""
    import tracemalloc

    text = "\n---\n".join([DEPLOY.rstrip("\n")] * 2_000)
    tracemalloc.start()
    found = [(x[0].number, len(x)) for x in yaml_lines.documents(text)]
    assert tracemalloc.get_traced_memory()[1] < 3 << 20
    tracemalloc.stop()
    assert len(found) == 6_000 and found[3][0] == found[0][0] + DEPLOY.count("\n") + 1
    assert [[x.number for x in d] for d in yaml_lines.documents("a: 1\n---\n---\nb: 2\n\n---")] == [[1], [4]] and list(yaml_lines.documents("")) == []
