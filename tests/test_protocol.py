"""Events, legs, results and the catalog's writer against their published cases."""

import json

import pytest
from pyspark.sql import functions as F

from tactus.operators import protocol, store


def test_legs(spark):
    full = {"grid": {"bpm": 120.5, "beats_per_bar": 3, "first_beat_ms": 7, "first_downbeat_ms": 9}, "beats": [{"beat_number": 2, "time_ms": 5}], "bt_phase_vote": -1, "bt_phase_agreement": 0.5, "algo_version": "x", "cfg_hash": "h"}
    rows = [full, {"grid": {"bpm": 99}, "beats": [{"time_ms": 5}, {"beat_number": 1, "time_ms": 8}]}, {"grid": {"bpm": 0}, "beats": [{}]}, {"grid": {"bpm": 9}, "beats": []}, {"beats": [{}]}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i long, v string")
    got = [r["g"] for r in df.select("i", protocol.leg_grid(F.col("v"), "fallback").alias("g")).orderBy("i").collect()]
    assert tuple(got[0])[:2] == (120.5, 3) and (got[0]["first_beat_ms"], got[0]["first_downbeat_ms"], got[0]["phase_vote"], got[0]["algo_version"]) == (7, 9, -1, "x")
    assert (got[1]["beats_per_bar"], got[1]["first_beat_ms"], got[1]["first_downbeat_ms"], got[1]["beats"][0]["n"], got[1]["algo_version"]) == (4, 5, 8, 0, "fallback")
    assert got[2:] == [None] * 3


def test_results(spark):
    e = {"id": "a", "bpm": 120.0, "beats_per_bar": 4, "beats": [[1, 500], [2, 1000]], "first_downbeat_ms": 500, "consensus": {"verdict": "agreed", "beat_this": {"phase_vote": 2, "phase_agreement": 0.8}, "relabel_beats": 2}}
    r = spark.createDataFrame([(json.dumps(e),)], "v string").select(protocol.result_of(F.col("v")).alias("r")).first()["r"]
    assert (r["beats"][1]["ms"], r["consensus"], r["dispute"], r["phase_vote"], r["relabel_beats"], r["shift_ms"]) == (1000, "agreed", "", 2, 2, 0)


def test_crashes(spark):
    items = spark.createDataFrame([(1, "a", ["grid", "key"]), (1, "b", ["grid"]), (2, "c", ["grid"]), (3, "d", ["grid"])], "batch long, id string, tasks array<string>")
    events = spark.createDataFrame([(1, "item_done", "b"), (2, "batch_done", None), (3, "batch_error", None)], "batch long, event string, id string")
    got = protocol.crashed(items, events, "engine exited before batch_done").orderBy("task").collect()
    assert [(r["batch"], r["id"], r["task"], r["code"], r["retryable"]) for r in got] == [(1, "a", "grid", "engine_crashed", True), (1, "a", "key", "engine_crashed", True)]


def test_event_lines(spark):
    row = spark.range(1).select(
        protocol.lines(protocol.progress(F.lit("a"), F.lit("decode"), F.lit(1), F.lit(3))).alias("p"),
        protocol.lines(protocol.warning(F.lit("a"), F.lit("key"), F.lit("key_failed"), F.lit(None).cast("string"))).alias("w"),
    ).first()
    assert row["p"] == '{"event":"progress","id":"a","stage":"decode","done":1,"total":3}' and row["w"] == '{"event":"item_warning","id":"a","task":"key","code":"key_failed"}'
    beats = spark.createDataFrame([([(1, 100), (2, 600)],)], "b array<struct<n: int, ms: long>>").select(protocol.on_timeline(F.col("b"), F.lit(0.0256)).alias("b")).first()["b"]
    assert [b["ms"] for b in beats] == [126, 626]


def test_inserts(spark):
    target = spark.createDataFrame([], "uuid string, name string, revision string").schema
    out = store.insertable(spark.createDataFrame([("", "a", "r"), ("u", "b", "r")], "uuid string, name string, revision string"), "catalogs", target)
    rows = {r["name"]: r["uuid"] for r in out.collect()}
    assert out.columns == ["uuid", "name"] and rows["b"] == "u" and len(rows["a"]) == 36
    assert store.stamped(out, "catalogs", "t").columns == ["uuid", "name", "revision"]
    for bad in (spark.createDataFrame([("x",)], "other string"), spark.createDataFrame([("x",)], "revision string")):
        with pytest.raises(ValueError):
            store.insertable(bad, "catalogs", target)
    assert len(store.revision_token()) == 32 != store.revision_token()


def test_version_gate(spark):
    versions = spark.createDataFrame([("catalog", 3), ("other", 1)], "name string, version int")
    store.checked_version(versions, {"catalog": 3})
    for wanted in ({"catalog": 4}, {"missing": 1}):
        with pytest.raises(ValueError):
            store.checked_version(versions, wanted)


def test_names_and_lists(spark):
    files = spark.createDataFrame([(0, "/a/x.mp3"), (0, "/a/z/x.mp3"), (1, "/b/x.mp3"), (1, "/b/y.WAV"), (1, "/b/.hid/q.mp3"), (1, "/b/n.txt")], "root_order int, path string")
    names = store.audio_by_name(files)
    assert {r["name"]: r["path"] for r in names.collect()} == {"x.mp3": "/a/z/x.mp3", "y.WAV": "/b/y.WAV"}
    entries = spark.createDataFrame([(1, "x.mp3", "s:a", "/q", True), (2, "n", "s:b", "/old", True), (3, "m", "t:a", "/gone", False)], "id int, file_name string, source string, stored_path string, stored_exists boolean")
    assert {r["id"]: r["audio"] for r in store.audio_path(entries, names).collect()} == {1: "/a/z/x.mp3", 2: "/old", 3: ""}
    allowed = store.allow_list(spark.createDataFrame([('[{"path":"x.mp3"},{"path":"m"}]',)], "value string"))
    assert [r["id"] for r in store.wanted(entries, "", allowed).orderBy("id").collect()] == [1, 3]
    assert [r["id"] for r in store.wanted(entries, "s:", limit=1).collect()] == [1]
    assert [r["file_name"] for r in store.allow_list(spark.createDataFrame([(" n ",), ("",)], "value string")).collect()] == ["n"]
    listed = store.by_time(spark.createDataFrame([(1, 5, "b"), (1, 2, "a")], "k int, at int, v string"), "k", "at").first()["rows"]
    assert [r["v"] for r in listed] == ["a", "b"]
