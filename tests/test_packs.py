"""Packs, live sources with fakes, module plans."""

import json

import pytest

from graphloom.sources import extract, live, packs


def test_select_path():
    assert list(packs.select_path("json", '{"a": {"x": "1", "y": "2"}, "l": ["p", "q"]}', "a.*")) == [("x", "1"), ("y", "2")]
    assert list(packs.select_path("json", '{"l": ["p", "q"]}', "l.*")) == [("p", ""), ("q", "")]
    assert list(packs.select_path("yaml", "deps:\n  x: 1\n  y: 2\n", "deps.*")) == [("x", "1"), ("y", "2")]
    assert list(packs.select_path("xml", '<a><b n="k" version="3"/></a>', "a/b/@n")) == [("k", "3")]


def test_packs(spark, monkeypatch):
    monkeypatch.setattr(extract, "_PARSERS", list(extract._PARSERS))
    packs.manifest_pack(json.dumps({"rules": [{"name": "conda", "file": "env.json", "format": "json", "path": "dependencies.*", "emit": "dependency", "ecosystem": "conda"}]}))
    packs.route_packs(json.dumps({"name": "own", "routes": [{"call": "add_route", "handler_arg": 1, "method": "get"}]}))
    files = spark.createDataFrame([("x/env.json", '{"dependencies": {"numpy": "2"}}'), ("a.py", "def h():\n    pass\nrouter.add_route('/p', h)\nrouter.add_route(p, h)\n")], "path string, content string")
    rows = extract.rows(files).collect()
    assert any(r.id == "dep:conda/numpy" for r in rows)
    assert {(r.source, r.target) for r in rows if r.relation == "handles"} == {("a.py::route:GET /p", "a.py::h")}
    for bad in ("{", '{"rules": [{"name": "x"}]}', '{"rules": [{"name": "x", "file": "f", "format": "ini", "path": "p", "emit": "task"}]}'):
        with pytest.raises(packs.PackError):
            packs.manifest_pack(bad)
    with pytest.raises(packs.PackError):
        packs.route_packs("[]")


class Fake:
    collections = staticmethod(lambda: ["users", "system.x"])
    sample = staticmethod(lambda name, most: [{"a": 1, "b": "x"}, {"a": "s"}])
    scan = staticmethod(lambda: (("u:%d" % i, "hash") for i in range(9000)))
    topics = staticmethod(lambda: [("orders", 3, 2), ("__consumer_offsets", 50, 3)])
    groups = staticmethod(lambda: [("billing", ["orders"])])
    streams = staticmethod(lambda: [{"name": "KV_x", "subjects": ["a"], "messages": 4}, {"name": "$SYS.y"}])


def test_live(spark):
    meta = lambda b, label: b.nodes.where(f"label = '{label}'").first().metadata
    m = live.mongodb(spark, "mongodb://u:p@h/db", Fake())
    assert meta(m, "users")["fields"] == "a (int|str)|b (str)" and m.nodes.count() == 2
    assert meta(live.redis(spark, "redis://h/0", Fake()), "u")["approx_count"] == "5000"
    k = live.kafka(spark, "kafka://h:9092", Fake())
    assert meta(k, "orders")["partitions"] == "3" and k.edges.where("relation = 'uses'").count() == 1 and k.nodes.count() == 3
    assert meta(live.nats(spark, "nats://h", Fake()), "KV_x")["store"] == "kv"
    assert isinstance(live.register(), list)


def test_module_plan():
    found = packs.expand_modules([{"path": "svc/*"}, {"name": "b", "paths": ["src/B", "tests/B"]}, {"path": "svc/a"}], ["svc/a", "svc/b", "src/B", "tests/B", "svc/a/in"])
    assert found == [("a", ["svc/a"]), ("b", ["svc/b"]), ("b", ["src/B", "tests/B"])]
    plan = packs.plan_tasks([("a", ["svc/a"]), ("in", ["svc/a/in"])])
    assert plan[0] == ("a", ["svc/a"], ["svc/a/in"]) and plan[-1] == ("", ["."], ["svc/a", "svc/a/in"])
