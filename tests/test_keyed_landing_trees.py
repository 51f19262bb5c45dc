"""Keyed replacement with versions, landing by a manifest, and trees of any depth."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkpanel.operators import hierarchy as H
from sparkpanel.sources import keyed
from sparkpanel.sources.keyed import KeyedTable
from sparkpanel.streaming import landing as L


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_many_keys_in_few_folders(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k", 8)
    assert t.read() is None
    d = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("v"))
    assert t.replace(d) == 1
    assert len(os.listdir(tmp_path / "t" / "v00000001")) <= 8 + 2  # and the mark of success
    assert t.replace(spark.createDataFrame([(5, 100), (5, 101), (200_000, 1)], "k long, v int")) == 2
    assert len([n for n in os.listdir(tmp_path / "t" / "v00000002") if n.startswith("own_bucket=")]) <= 2
    assert rows(t.read().where("k IN (5, 6, 200000)"), "k", "v") == [(200_000, 1), (5, 100), (5, 101), (6, 6)]
    assert t.read().count() == 100_002 and t.read(1).count() == 100_000 and t.read(1).where("k = 5").first()["v"] == 5
    assert t.replace(d.limit(0)) is None and t.commits() == [1, 2]
    assert t.replace(d.limit(0), spark.createDataFrame([(5,), (None,)], "k long")) == 3 and t.read().where("k = 5").isEmpty()
    t.vacuum()
    assert t.commits() == [3] and t.read().count() == 100_000


def test_null_keys_and_no_rows(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k", 2)
    t.replace(spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int"))
    t.replace(spark.createDataFrame([(None, 3)], "k string, v int"))
    assert rows(t.read(), "k", "v") == [("a", 2), (None, 3)]
    t.replace(t.read().limit(0), t.read().select("k"))
    assert t.read().count() == 0 and t.read().columns == ["k", "v"]


def test_failed_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k", 4)
    t.replace(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "_commit", fail)
    with pytest.raises(RuntimeError):
        t.replace(spark.createDataFrame([("a", 9)], "k string, v int"))
    monkeypatch.undo()
    assert rows(t.read(), "k", "v") == [("a", 1), ("b", 2)]
    t.replace(spark.createDataFrame([("a", 10)], "k string, v int"))
    assert rows(t.read(), "k", "v") == [("a", 10), ("b", 2)]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k", 4)
    t.replace(spark.createDataFrame([("a", 1)], "k string, v int"))
    inner = keyed.saved

    def slow(df, name):
        monkeypatch.setattr(keyed, "saved", inner)
        KeyedTable(spark, t.path, "k").replace(spark.createDataFrame([("b", 2)], "k string, v int"))
        return inner(df, name)

    monkeypatch.setattr(keyed, "saved", slow)
    with pytest.raises(ValueError, match="another writer"):
        t.replace(spark.createDataFrame([("c", 3)], "k string, v int"))
    assert rows(t.read(), "k", "v") == [("a", 1), ("b", 2)]


def test_landing_by_manifest(spark, tmp_path):
    schema, source, target = T.StructType.fromDDL("x int, s string"), f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    os.makedirs(tmp_path / "in" / "deep")

    def put(name, *values):
        with open(tmp_path / "in" / name, "w") as f:
            f.writelines(json.dumps({"x": v, "s": " a "}) + "\n" for v in values)

    land = lambda **more: L.land_files(spark, source, schema, target, "json", "*.json", **more)
    put("a.json", 1, 2)
    put("deep/b.json", 3)
    assert land(transform=lambda d: d.withColumn("s", F.trim("s"))) == 2 and land() == 0
    assert rows(L.landed(spark, target), "x", "s") == [(1, "a"), (2, "a"), (3, "a")]
    assert {r[0].rsplit("/", 1)[1] for r in L.landed(spark, target).select("_source_file").collect()} == {"a.json", "b.json"}
    put("c.json", 4)
    time.sleep(1.1)
    put("a.json", 7)
    assert land(changed="keep") == 1
    with pytest.raises(ValueError, match="a.json"):
        land(changed="refuse")
    assert rows(L.landed(spark, target), "x") == [(1,), (2,), (3,), (4,)]
    assert land() == 1 and rows(L.landed(spark, target), "x") == [(3,), (4,), (7,)]
    time.sleep(1.1)
    (tmp_path / "in" / "a.json").write_text("\n")  # a file that has lost its rows
    assert land() == 1 and rows(L.landed(spark, target), "x") == [(3,), (4,)] and L.manifest(spark, target).count() == 3


def edges(spark, data):
    return spark.createDataFrame(data, "code string, title string, parent string")


def test_chain_of_twelve_levels(spark):
    data = [(f"n{k}", f"t{k}", f"n{k - 1}" if k else None) for k in range(12)] + [("side", "s", "n3"), ("lone", "x", None)]
    got = {r["code"]: json.loads(r["node"]) for r in H.tree_json(edges(spark, data)).collect()}
    assert set(got) == {"n0", "lone"} and got["lone"] == {"code": "lone", "title": "x"}
    node = got["n0"]
    for k in range(12):
        assert node["code"] == f"n{k}" and len(node.get("children", [])) == (0 if k == 11 else 2 if k == 3 else 1)
        node = next((c for c in node.get("children", []) if c["code"] == f"n{k + 1}"), None)
    deep = {r["code"]: (r["depth"], r["path"]) for r in H.tree_paths(edges(spark, data)).collect()}
    assert deep["n11"] == (11, "/".join(f"n{k}" for k in range(12))) and deep["side"][0] == 4


@pytest.mark.parametrize("bad", [[("a", "t", None), ("b", "t", "c"), ("c", "t", "b")], [("a", "t", None), ("b", "t", "gone")], [("a", "t", None), ("b", "t", "a"), ("b", "u", "a")], [("a", "t", "a")]])
def test_no_tree(spark, bad):
    with pytest.raises(ValueError, match="not a tree"):
        H.tree_json(edges(spark, bad))


def test_empty_tree(spark):
    assert H.tree_json(edges(spark, [])).count() == 0 and H.tree_paths(edges(spark, [])).count() == 0


def test_split_by_level(spark):
    titles = spark.createDataFrame([("01 ", "division", "A"), ("45.2", "group", "G"), ("99", "division", None), ("01", "other", "B")], "Key string, level string, section string")
    d = spark.createDataFrame([(" 01", 1), ("45.2", 2), ("99", 3), ("zz", 4), (None, 5)], "code string, level int")
    with_titles = titles.limit(3)
    got = rows(H.split_by_level(d, "code", with_titles), "level", "frame", "section")
    assert got == sorted([(1, "division", None), (1, "section", "A"), (2, "group", None), (3, "division", None), (4, "_unmatched", None), (5, "_unmatched", None)], key=str)
    assert H.split_by_level(d, "code", with_titles, unmatched=False).count() == 4
