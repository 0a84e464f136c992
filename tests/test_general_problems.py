"""Nested records, drifting schemas, differences of copies: small cases of every defined result."""

import json

import pytest
from pyspark.sql import functions as F

from reelsieve.operators.components import connected_components
from reelsieve.operators.diff import found_rows, table_diff
from reelsieve.operators.drift import flood, name_similarity, schema_changes, unify
from reelsieve.operators.nested import child_table, depth_of, label_nodes, schema_tables, shred
from reelsieve.plans.nested_queries import p2_found


def test_labels_and_parents():
    nodes = list(label_nodes({"a": [{"b": 1}, None], "c.d": {}}))
    assert [(d, p) for d, p, *_ in nodes] == [([], "$"), ([0], "$.a"), ([0, 0], "$.a[]"), ([0, 0, 0], "$.a[].b"), ([0, 1], "$.a[]"), ([1], '$["c.d"]')]


def test_shred_edges(spark):
    deep = '{"x":' * 300 + "1" + "}" * 300
    t = spark.createDataFrame([(1, '{"a":[1,"2",null,{"t":3}]}'), (2, None), (3, ""), (4, "{broken"), (5, json.dumps(json.dumps({"a": []}))), (6, deep), (None, '{"a": 1}'), (1, '{"a":[1,"2",null,{"t":3}]}')], "id bigint, doc string").withColumn("dewey", F.lit("clash")).withColumn("id0", F.lit(1))
    n = shred(t, "doc", ["id"])
    assert n.where("id = 1").count() == 2 * 7 and n.where("id in (2, 3, 4)").count() == 0
    assert n.where("id = 5").count() == 2 and n.where("id = 6").count() == 301 and n.where("id is null").count() == 2
    assert n.where("dewey = array() and parent_dewey is not null").count() == 0
    kids = child_table(n.where("id = 1").distinct(), ["id"], "$.a[]", {"t": "t"})
    assert sorted((r.pos, r.t) for r in kids.collect()) == [(0, None), (1, None), (2, None), (3, "3")]
    assert {r.schema_path for r in schema_tables(n.where("id = 1")).collect()} == {"$", "$.a", "$.a[]", "$.a[].t"}
    assert shred(t.where("false"), "doc", ["id"]).count() == 0


def test_shred_struct(spark):
    t = spark.sql("SELECT 1 id, named_struct('a', array(named_struct('b', CAST(NULL AS int)))) s")
    assert {r.schema_path for r in shred(t, "s", ["id"]).collect()} == {"$", "$.a", "$.a[]", "$.a[].b"}


def test_typed_labels_are_those_of_the_json(spark):
    t = spark.sql("""SELECT 1 id, named_struct('a', array(named_struct('b', CAST(NULL AS int), 'c.d', true), NULL), 'e', CAST(NULL AS struct<f: string>), 'g', array(array(1.5D, NULL), NULL), 'h', 'x') s
        UNION ALL SELECT 2, NULL UNION ALL SELECT 3, named_struct('a', NULL, 'e', named_struct('f', ''), 'g', array(), 'h', NULL)""")
    cols = ["id", "dewey", "parent_dewey", "schema_path", "name", "node_kind", "value"]
    typed = shred(t, "s", ["id"]).select(cols)
    text = shred(t.withColumn("s", F.to_json("s", {"ignoreNullFields": "false"})), "s", ["id"]).select(cols)
    rows = lambda x: sorted((repr(tuple(r)) for r in x.collect()))
    assert rows(typed) == rows(text) and typed.count() == 19
    assert "MapInArrow" not in typed._jdf.queryExecution().toString()
    keep, enter = (lambda p, _: p.endswith(".f") or p == "$.g[][]"), (lambda p: p == "$" or p.startswith(("$.e", "$.g")))
    some = shred(t, "s", ["id"], keep=keep, enter=enter).select(cols)
    assert rows(some) == rows(text.where("schema_path in ('$.e.f', '$.g[][]')"))


def test_depth_counts_steps_not_dots():
    assert [depth_of(p) for p in ("$", "$.a", "$.a[].b", '$["c.d"]', '$["x[].y"].z[]')] == [0, 1, 3, 1, 3]


def test_child_rows_of_both_forms(spark, tmp_path):
    docs = [
        (1, {"methods": {"nms": {"selection_time_seconds": "1.5", "extraction": {"brand": {"logo_timestamps": [1, "2", {"start": 3, "end": 4}, {}, -1, None, "n/a", {"confidence": 1, "t": "5"}]}, "promotion": {"promo_present": "YES"}}}, "kmeans": None}}),
        (2, {"methods": [{"method": "hybrid", "timings": {"selection_time_seconds": 0}, "extraction": {"brand": {"logo_timestamps": {"at": 7}}, "promotion": {"promo_present": 0}}}]}),
        (3, {"methods": {"uniform_1.0": {"selection_time_seconds": -1, "extraction": {"brand": {"logo_timestamps": "8"}}}}}),
    ]
    rows = [(i, json.dumps(d)) for i, d in docs] + [(4, None), (5, "{"), (1, json.dumps(docs[0][1]))]
    spark.createDataFrame(rows, "result_id bigint, result_doc string").write.parquet(f"{tmp_path}/video_results.parquet")
    spark.sql("SELECT 9 metric_id, 'm' method, named_struct('brand', named_struct('logo_timestamps', array(double('nan'), 1.0D, NULL, -1.0D)), 'promotion', named_struct('promo_present', true)) extraction_data UNION ALL SELECT 10, 'm', NULL").write.parquet(f"{tmp_path}/ablation_metrics.parquet")
    got = {tuple(r) for r in p2_found(spark, str(tmp_path)).collect()}
    v = "video_results"
    assert got == {(v, 1, "nms", "logo", i) for i in (0, 1, 2, 7)} | {(v, 1, "nms", "promo", 0), (v, 1, "nms", "selection", 0), (v, 2, "hybrid", "logo", 0), (v, 2, "hybrid", "selection", 0), (v, 3, "uniform_1.0", "logo", 0), ("ablation_metrics", 9, "m", "logo", 1), ("ablation_metrics", 9, "m", "promo", 0)}


def _records(files):
    out, n = [], 0
    for at, (name, recs) in enumerate(files):
        for r in recs:
            n += 1
            out.append((n, "r", name, at, r if isinstance(r, str) else json.dumps(r)))
    return out


def test_drift_changes(spark):
    rec = lambda v, **x: {"video": v, "method": "m", **x}
    files = [
        ("f1", [rec("a", err="x", n=1, gone=1), rec("b", err="y", n=2), "{broken", "[]"]),
        ("f2", [rec("a", error="x", n="1", fresh=None), rec("b", error="y", n="2"), rec("b", error="y", n="2")]),
        ("f3", [rec("a", error="x", fresh={"k": 1}), rec("c", error=5)]),
    ]
    t = spark.createDataFrame(_records(files), "id int, run string, file string, at int, js string")
    got = {tuple(r)[1:] for r in schema_changes(t, "js", "run", "file", "at", (("video", "method"),)).collect()}
    assert got == {("f2", "renamed", "err", "error"), ("f2", "removed", "gone", ""), ("f2", "added", "fresh", ""), ("f2", "retyped", "n", ""), ("f3", "removed", "n", ""), ("f3", "retyped", "error", "")}
    assert schema_changes(t.where("false"), "js", "run", "file", "at", (("video", "method"),)).count() == 0
    wide = unify(t, "js", "run", "file", "at", (("video", "method"),))
    assert "error" in wide.columns and "err" not in wide.columns
    assert sorted(r.error for r in wide.where("file_name = 'f1'").collect()) == ["x", "y"]


def test_flooding_prefers_like_structure():
    old, new = {"bare_error": {"kinds": {"text"}, "members": set()}, "keys": {"kinds": {"object"}, "members": {"code"}}}, {"bareErr": {"kinds": {"text"}, "members": set()}, "list": {"kinds": {"object"}, "members": {"code"}}}
    s = flood(old, new, {(a, b): name_similarity(a, b) for a in old for b in new})
    assert s["bare_error", "bareErr"] > s["bare_error", "list"] and s["keys", "list"] > s["keys", "bareErr"]


def test_diff_edges(spark):
    a = spark.createDataFrame([("k1", 1, " x ", 1.0, 1), ("k1", 9, "old", 9.0, 0), ("k2", None, "", None, 1), (None, 1, "n", 1.0, 1), ("k4", 1, None, float("nan"), 1), ("k4", 1, None, float("nan"), 1), ("only", 1, "a", 1.0, 1)], "key string, c int, t string, x double, at int")
    b = spark.createDataFrame([("k1", "1", "x", 1.0000001, 1, "z"), ("k2", " ", None, 2.0, 1, "z"), (None, "1", "n", 1.0, 1, "z"), ("k4", "oops", "", float("nan"), 1, "z"), ("other", "1", "a", 1.0, 1, "z")], "key string, c string, t string, x double, at int, l string")
    d = table_diff(a, b, {"key": F.col("key")}, order_by="at")
    got = {tuple(r) for r in found_rows(d, ["key"]).collect()}
    assert got == {("k2", "x", "value"), ("k4", "c", "value"), ("only", "", "only_left"), ("other", "", "only_right")}
    assert table_diff(a.where("false"), b, {"key": F.col("key")}, order_by="at").where("side = 'only_right'").count() == 5
    assert table_diff(a.where("false"), b.where("false"), {"key": F.col("key")}).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 0)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 0}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b", max_rounds=1)
