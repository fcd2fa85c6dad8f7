"""Formats, filters and frames: published cases, chunk invariance, and a stream against its batch."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.sources import codecs
from tactus.streaming import frames


def test_features_round_trip(spark):
    good = codecs.packed_features(np.zeros((23, 20)), 1000, bytes(32))
    bad = bytearray(good)
    bad[65] = 0x7C
    out = {r["path"]: r for r in codecs.read_features(spark.createDataFrame([("a", good), ("b", good[:-1]), ("c", bytes(bad)), ("d", None)], "path string, content binary")).collect()}
    assert out["a"]["frames"] == 20 and out["a"]["duration_ms"] == 1000 and len(out["a"]["values"]) == 23
    assert all(out[k]["error"] for k in "bcd")


def section(fourcc, body, head=12):
    return fourcc + struct.pack(">II", head, 12 + len(body)) + body


def test_sections(spark):
    name = "/x/y.mp3\0".encode("utf-16-be")
    tags = section(b"PPTH", struct.pack(">I", len(name)) + name, 16) + section(b"PWAV", bytes(8) + b"\xe5\x1f", 20)
    data = b"PMAI" + struct.pack(">II", 28, 28 + len(tags)) + bytes(16) + tags
    rows = codecs.read_sections(spark.createDataFrame([("a", data), ("b", b"zz")], "path string, content binary")).orderBy("off")
    got = rows.select("fourcc", codecs.big_endian(F.col("raw"), 8, 4).alias("size"), codecs.payload(F.col("raw"), F.col("len_header")).alias("p"), codecs.audio_path(F.col("raw")).alias("name")).collect()
    assert [r["fourcc"] for r in got] == ["PPTH", "PWAV"] and got[0]["name"] == "/x/y.mp3" and bytes(got[1]["p"]) == b"\xe5\x1f"
    with pytest.raises(ValueError):
        codecs.sections(data[:36] + struct.pack(">I", 5) + data[40:])


def test_canonical():
    assert codecs.canonical({"b": 1, "a": {"z": True, "y": [1.5, 0.005, 4]}, "m": 0.0}) == '{"a":{"y":[1.5,0.005,4],"z":true},"b":1,"m":0.0}'
    assert [codecs.canonical(x) for x in (0.0, 1.0, 150.0, 0.005, 1e-05, 1e16)] == ["0.0", "1.0", "150.0", "0.005", "1e-05", "1e+16"]


def test_small_columns(spark):
    one = spark.range(1)
    assert one.select(codecs.plain_base64(F.lit(b"hi")).alias("x")).first()["x"] == "aGk="
    assert [one.select(codecs.start_time(F.lit(t)).alias("x")).first()["x"] for t in ("0.025057\n", "0.025057,\n", "N/A", "")] == [0.025057, 0.025057, 0.0, 0.0]
    with pytest.raises(Exception):
        one.select(codecs.start_time(F.lit("2.5"))).collect()


def test_events_and_checksums(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"seq":1,"event":"batch_started","items":["a","b"]}\nnot json\n{"seq":2,"event":"batch_done","items":2}\n')
    rows = codecs.read_events(spark, str(tmp_path / "e.json")).orderBy("seq").collect()
    assert rows[0]["item_ids"] == ["a", "b"] and rows[1]["item_count"] == 2 and len(rows) == 2
    (tmp_path / "sums.txt").write_text("aa  kit-linux-amd64.tar.gz\nbb *kit-darwin-arm64.tar.gz\ncc notes.txt\n")
    assert {tuple(r)[:2] for r in codecs.read_checksums(spark, str(tmp_path / "sums.txt"), "kit").collect()} == {("linux/amd64", "aa"), ("darwin/arm64", "bb")}


def folded(samples, rate, size):
    state = frames.Track(rate)
    out = [f for i in range(0, len(samples), size) for f in state.push(samples[i : i + size])]
    return out + state.finish()


def test_frames_of_silence():
    assert folded(np.zeros(44100), 44100, 4096) == [(0, 150, bytes(450))]


def test_frames_for_any_chunks():
    t = np.arange(int(2.5 * 22050)) / 22050
    x = np.trunc((0.5 * np.sin(2 * np.pi * 70 * t) + 0.3 * np.sin(2 * np.pi * 1200 * t) + 0.2 * np.sin(2 * np.pi * 8000 * t)) * 32767)
    whole = folded(x, 22050, len(x))
    assert [f[0] for f in whole] == [0, 150, 300] and sum(f[1] for f in whole) == 375
    assert folded(x, 22050, 997) == whole and folded(x, 22050, 5000) == whole
    short = folded(np.trunc(np.sin(np.arange(451) / 7) * 20000), 22050, 100)
    assert len(short) == 1 and short[0][1] == 4


def test_state_survives_text():
    x = np.trunc(np.sin(np.arange(30000) / 7) * 20000)
    state, out = frames.Track(22050), []
    for i in range(0, len(x), 3000):
        out += state.push(x[i : i + 3000])
        state = frames.Track.of(state.text())
    assert out + state.finish() == folded(x, 22050, 30000)


def test_stream_equals_batch(spark, tmp_path):
    x = np.trunc(np.sin(np.arange(24000) / 9) * 20000).astype(int).tolist()
    rows = [(t, i, x[i * 4000 : (i + 1) * 4000], i == 5) for i in range(6) for t in ("p", "q")]
    schema = "track string, seq long, samples array<int>, last boolean"
    for i in range(3):
        spark.createDataFrame(rows[4 * i : 4 * i + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = frames.stream_frames(stream, 8000).writeStream.format("memory").queryName("drawn").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["track"], r["offset"], bytes(r["data"])) for r in spark.table("drawn").collect()}
    want = {(r["track"], r["offset"], bytes(r["data"])) for r in frames.batch_frames(spark.createDataFrame(rows, schema), 8000).collect()}
    assert got == want and len(got) == 6
