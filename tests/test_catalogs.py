"""Catalog files: written, gated, read and merged, on the published fixture's shapes."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tactus.sources import catalogs as C

ANALYSES = "path string, _row long, id long, track_uuid string, provider string, version string, selected long"


def tables(spark):
    return {
        "beats": spark.createDataFrame([("a", 1, 1, "[[1,11700,49]]"), ("a", 2, 2, "[[1,11700,561]]")], "path string, _row long, analysis_id long, beats_json string"),
        "tracks": spark.createDataFrame([("a", 1, "t1", "Alive", 11700), ("b", 1, "t2", None, None)], "path string, _row long, uuid string, title string, tempo long"),
        "analyses": spark.createDataFrame([("a", 1, 1, "t1", "rekordbox", "6", 0), ("a", 2, 2, "t1", "house", "1", 1)], ANALYSES),
        "waveforms": spark.createDataFrame([("a", 1, 1, bytearray(400))], "path string, _row long, analysis_id long, data binary"),
        "catalogs": spark.createDataFrame([("a", 1, "main"), ("a", 2, "corpus")], "path string, _row long, kind string"),
    }


def back(files, table, like):
    return C.read_table(files, table, like.drop("path", "_row").schema)


def test_round_trip(spark):
    made = tables(spark)
    files = C.write_files(made).cache()
    assert sorted(r["path"] for r in files.collect()) == ["a", "b"]
    for name, df in made.items():
        assert sorted(map(str, back(files, name, df).collect())) == sorted(map(str, df.select("path", "_row", *df.drop("path", "_row").columns).collect()))
    assert back(files, "no such table", made["tracks"]).count() == 0
    assert [r["x"] for r in C.read_table(files, "tracks", spark.createDataFrame([], "x string").schema).collect()] == [None, None]


def bad(sql):
    db = sqlite3.connect(":memory:")
    db.executescript(sql)
    return bytearray(db.serialize())


def test_version_gate(spark):
    schema = spark.createDataFrame([], "uuid string").schema
    wrong = [
        ("new", bad("PRAGMA user_version = 2"), "unsupported catalog schema 2"),
        ("unmigrated", bad(C._VERSIONS + "; PRAGMA user_version = 1"), "mismatch: 1/0"),
        ("none", bad("PRAGMA user_version = 1; CREATE TABLE x (y)"), "not a catalog"),
        ("bytes", bytearray(b"no database at all, but long enough to be read as one" * 20), "not a catalog"),
    ]
    files = spark.createDataFrame([(p, c) for p, c, _ in wrong], "path string, content binary")
    got = {r["path"]: r["error"] for r in C.read_table(files, "tracks", schema, errors=True).collect()}
    assert all(said in got[p] for p, _, said in wrong)
    with pytest.raises(Exception, match="unsupported catalog schema 2"):
        C.read_table(files.where("path = 'new'"), "tracks", schema).collect()


def test_merge_with_children(spark):
    made = tables(spark)
    incoming = {
        "analyses": spark.createDataFrame([("a", 1, 7, "x", "rekordbox", "7", 1), ("a", 2, 8, "x", "rekordbox", "6", 1), ("b", 1, 1, "x", "leg", None, 1), ("c", 1, 1, "x", "p", "1", 1)], ANALYSES),
        "cues": spark.createDataFrame([("a", 1, 7, 10), ("a", 2, 8, 20), ("b", 1, 1, 30)], "path string, _row long, analysis_id long, time_ms long"),
        "beats": spark.createDataFrame([("a", 1, 7, "[[1,11700,49],[2,11700,561]]")], "path string, _row long, analysis_id long, beats_json string"),
        "catalogs": spark.createDataFrame([("a", 1, "main"), ("a", 2, "devicelib"), ("b", 1, "devicelib")], "path string, _row long, kind string"),
        "catalog_tracks": spark.createDataFrame([("a", 1, "x", "u1")], "path string, _row long, track_uuid string, uuid string"),
    }
    out = C.merged(made, incoming)
    rows = {(r["path"], r["provider"], r["version"]): (r["id"], r["track_uuid"], r["selected"]) for r in out["analyses"].collect()}
    assert rows == {("a", "rekordbox", "6"): (1, "t1", 0), ("a", "house", "1"): (2, "t1", 1), ("a", "rekordbox", "7"): (3, "t1", 0), ("b", "leg", None): (1, "t2", 0)}
    assert sorted((r["path"], r["analysis_id"], r["time_ms"]) for r in out["cues"].collect()) == [("a", 3, 10), ("b", 1, 30)]
    assert sorted((r["analysis_id"], r["_row"]) for r in out["beats"].collect()) == [(1, 1), (2, 2), (3, 3)]
    assert sorted((r["path"], r["kind"]) for r in out["catalogs"].collect()) == [("a", "corpus"), ("a", "devicelib"), ("b", "devicelib")]
    assert [(r["track_uuid"], r["uuid"]) for r in out["catalog_tracks"].collect()] == [("t1", "u1")]
    again = C.merged(out, incoming)  # nothing is new any more
    assert again["analyses"].count() == 4 and again["cues"].count() == 2 and again["catalogs"].count() == 3
    files = C.write_files(out)
    assert back(files, "analyses", out["analyses"]).where(F.col("selected") == 1).count() == 1
