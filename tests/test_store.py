"""Collections as logs of changes."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from nodelake import api
from nodelake.operators import embed
from nodelake.operators.store import SCHEMA, Store


def nodes(spark, rows):
    """Nodes by (id, path, content)."""
    known = {"id": 0, "document_path": 1, "content": 2}
    return spark.createDataFrame([tuple(r[known[f.name]] if f.name in known else None for f in SCHEMA) for r in rows], SCHEMA)


def there(store):
    return sorted((r["id"], r["content"]) for r in store.nodes("c").collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_changes_hide_older_nodes(spark, store):
    store.upsert("c", nodes(spark, [("1", "a", "x"), ("2", "a", "y"), ("3", "b", "z")]))
    store.upsert("c", nodes(spark, [("2", "a", "new")]))
    assert there(store) == [("1", "x"), ("2", "new"), ("3", "z")]
    gone = store.sync("c", nodes(spark, [("4", "a", "again")]), spark.createDataFrame([("a",), ("none",)], "document_path string"))
    assert there(store) == [("3", "z"), ("4", "again")] and sorted(r[0] for r in gone.collect()) == ["a", "none"]
    assert store.delete_by_document_paths("c", ["b"]) == 1 and there(store) == [("4", "again")]
    store.upsert("c", nodes(spark, [("3", "b", "back")]))  # what was deleted may come again
    assert there(store) == [("3", "back"), ("4", "again")]


def test_a_change_writes_itself_alone(spark, store):
    store.replace("c", nodes(spark, [(str(i), f"p{i}", "x" * 500) for i in range(2000)]))
    before = store._log("c")
    store.sync("c", nodes(spark, [("new", "p1", "y")]), spark.createDataFrame([("p1",)], "document_path string"))
    after = store._log("c")
    assert after[:-1] == before and spark.read.parquet(f"{store.path}/c/{after[-1][2]}/nodes").count() == 1
    assert store.count("c") == 2000


def test_merging_and_compacting_keep_the_nodes(spark, store):
    store.MERGE = 2
    want = {}
    for i in range(7):
        rows = [(f"{i}-{k}", f"p{k}", str(i)) for k in range(3)]
        store.sync("c", nodes(spark, rows[i % 3 :]), spark.createDataFrame([(r[1],) for r in rows[i % 3 :]], "document_path string"))
        for k in range(i % 3, 3):
            want[f"p{k}"] = (f"{i}-{k}", str(i))
        assert there(store) == sorted(want.values())
    assert len(store._log("c")) <= 4
    store.compact("c")
    store.vacuum("c")
    assert there(store) == sorted(want.values()) and len(store._log("c")) == 1
    store.SHARE = 10**12  # any change is a large one
    store.upsert("c", nodes(spark, [("z", "pz", "z")]))
    assert [kind for _, kind, _ in store._log("c")] == ["full"] and store.count("c") == len(want) + 1


def test_a_failed_write_leaves_no_trace(spark, store):
    store.upsert("c", nodes(spark, [("1", "a", "x")]))
    bad = nodes(spark, [("2", "b", "y")]).withColumn("content", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):
        store.upsert("c", bad)
    assert there(store) == [("1", "x")]


def test_modes(spark, tmp_path):
    with pytest.raises(ValueError):
        Store.connect(spark, {"mode": "remote"})
    assert Store.connect(spark, {"mode": "local", "path": "/x/"}).path == "/x"
    a, b = (Store.connect(spark, {"mode": "memory"}) for _ in range(2))
    a.upsert("c", nodes(spark, [("1", "a", "x")]))
    assert a.path != b.path and b.count("c") == 0
    a._remove()
    b._remove()


def test_embedders():
    import pandas as pd

    assert embed.embedder("hashed") is embed.hashed
    with pytest.raises(ValueError):
        embed.embedder("nothing")
    one, two, none = embed.hashed(pd.Series(["red apple apple", "a red apple", None]))
    assert len(one) == embed.SIZE and sum(x * x for x in one) == pytest.approx(1) and not any(none)
    assert sum(x * y for x, y in zip(one, two)) > 0.5
    assert embed.query_vector("red apple apple") == [float(x) for x in one]


def test_server_answers(store):
    ask = lambda **m: json.loads(api.respond(store, json.dumps({"jsonrpc": "2.0", "id": 1} | m)))
    assert {t["name"] for t in ask(method="tools/list")["result"]["tools"]} == set(api.TOOLS)
    assert ask(method="tools/call", params={"name": "search", "arguments": {"name": "x", "query": "q", "other": 1}})["error"]["code"] == api.BAD_PARAMS
    assert ask(method="nothing")["error"]["code"] == api.NO_METHOD
    assert api.respond(store, json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"})) is None
    assert json.loads(api.respond(store, "[1"))["error"]["code"] == api.PARSE_ERROR
