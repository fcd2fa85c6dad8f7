"""Arbitration, rulers, references and row values against their published cases."""

import struct

import pytest
from pyspark.sql import functions as F

from tactus.functions import rows as R
from tactus.operators import cues, reports, score
from tactus.sources import codecs


def grid(bpm, first, count=64):
    return [((i % 4) + 1, first + int(i * 60000 / bpm + 0.5)) for i in range(count)]


#: Ours, theirs, vote, agreement, whether to arbitrate; verdict, shift, relabel, dispute, a beat.
CASES = [
    ((126, 0), (126, 0), 0, 0.0, True, "agreed", None, None, "", (0, 1, 0)),
    ((120, 0), (120, 250), 0, 0.0, True, "agreed", 250, None, "", (0, 1, 250)),
    ((126, 0), (126, 0), 2, 0.75, True, "agreed", None, 2, "", (2, 1, None)),
    ((126, 0), (126, 0), 2, 0.65, True, "disputed", None, None, "downbeat vote +2 beats (0.65 agree)", (0, 1, 0)),
    ((126, 0), (126, 0), 3, 0.69, True, "disputed", None, None, "downbeat vote -1 beats (0.69 agree)", (0, 1, 0)),
    ((120, 0), (120, 250), 0, 0.0, False, "disputed", None, None, "origin -250ms", (0, 1, 0)),
    ((120, 0), (128, 0), 0, 0.0, True, "disputed", None, None, "bpm 120.00 vs 128.00", (0, 1, 0)),
    ((120, 250), (120, 0), 0, 0.0, True, "agreed", -250, None, "", (0, 1, 0)),
    ((120, 100), (120, 860), 0, 0.0, True, "disputed", 760, None, None, (0, 1, 860)),
]


@pytest.mark.parametrize("case", CASES)
def test_arbitration(spark, case):
    (ob, of), (tb, tf), vote, agreement, arbitrate, verdict, shift, relabel, dispute, (at, n, ms) = case
    row = (float(ob), 4, grid(ob, of), float(tb), 4, tf, tf, vote, agreement)
    df = spark.createDataFrame([row], "o_bpm double, o_bar long, o_beats array<struct<n: long, ms: long>>, t_bpm double, t_bar long, t_first_ms long, t_down_ms long, vote long, agreement double")
    got = reports.arbitrated(df, arbitrate).first()
    assert (got["shift_ms"], got["relabel_beats"]) == (shift, relabel)
    if dispute is not None:
        assert (got["verdict"], got["dispute"]) == (verdict, dispute)
    assert got["beats"][at]["n"] == n and ms in (None, got["beats"][at]["ms"])


def test_votes_fold_by_their_own_bar(spark):
    row = spark.range(1).select(reports.vote_dispute(F.lit(2), F.lit(0.7), F.lit(3)).alias("three"), reports.vote_dispute(F.lit(2), F.lit(0.7), F.lit(0)).alias("none")).first()
    assert row["three"] == "downbeat vote -1 beats (0.70 agree)" and row["none"] == "downbeat vote +2 beats (0.70 agree)"


def test_rulers(spark):
    rows = [(0.0, 0.5, 100.0, 0.25), (120.0, 0.4, 100.0, 0.25), (0.0, None, 100.0, 250 / 600), (0.0, None, 0.0, 0.0), (0.0, 0.0, 100.0, 250 / 600)]
    pairs = spark.createDataFrame([(i, b, g, x) for i, (b, g, x, _) in enumerate(rows)], "i long, ref_bpm double, got_gap double, got_bpm double")
    pairs = pairs.withColumns({"ref_bar": F.lit(4), "got_bar": F.lit(4), "ref_downbeat_ms": F.lit(1000), "got_downbeat_ms": F.lit(1125) + F.when(F.col("i") >= 2, 125).otherwise(0)})
    assert [r["phase_beats"] for r in score.score(pairs).orderBy("i").collect()] == [pytest.approx(x[3]) for x in rows]


def test_notes(spark):
    row = spark.range(1).select(
        reports.timeline_note(F.lit(25.057), F.lit(-25), F.lit("mp3")).alias("a"),
        reports.consensus_note(F.lit("agreed"), F.lit(2), F.lit(0.75), F.lit(250), F.lit(None), F.lit("")).alias("b"),
        reports.consensus_note(F.lit("disputed"), F.lit(None), F.lit(None), F.lit(None), F.lit(-1), F.lit("x")).alias("c"),
        reports.identity_note(F.lit("0123456789abcdef"), F.lit("v2")).alias("d"),
    ).first()
    assert tuple(row) == ("+25.057 ms applied as -25 (mp3)", "agreed; vote +2 at 0.75; shifted +250 ms", "disputed; relabelled -1 beats; x", "0123456789ab (v2)")


def test_references(spark):
    got = spark.createDataFrame([("a", 121.0, None, 0), ("b", 99.0, 40, 3)], "path string, bpm double, first_downbeat_ms int, beats_per_bar int")
    refs = spark.createDataFrame([("a", 1.0, 5, 4, "n"), ("b", 1.0, 5, 4, ""), ("c", 7.0, 8, 3, "")], "path string, bpm double, first_downbeat_ms int, beats_per_bar int, note string")
    out = {r["path"]: (r["bpm"], r["first_downbeat_ms"], r["beats_per_bar"], r["note"]) for r in reports.reference_of(got, refs, "path").collect()}
    assert out == {"a": (121.0, 5, 4, "n"), "b": (99.0, 40, 3, ""), "c": (7.0, 8, 3, "")}


def test_row_values(spark):
    df = spark.createDataFrame([("file:///a%20b/c+d.mp3", "[[1,12000],[2,1,2,9]]", "aGk"), ("http://x/y", " ", "a?=="), ("file://%zz", None, "aGk=\r\n")], "uri string, tuples string, b64 string")
    got = df.select(R.path_of_uri(F.col("uri")).alias("p"), R.read_beat_tuples(F.col("tuples")).alias("t"), R.from_base64(F.col("b64")).alias("b")).collect()
    assert [r["p"] for r in got] == ["/a b/c+d.mp3", "", ""]
    assert [r["t"] for r in got] == [[[1, 12000, 0], [2, 1, 2]], None, None]
    assert [None if r["b"] is None else bytes(r["b"]) for r in got] == [b"hi", None, b"hi"]
    with pytest.raises(Exception):
        spark.createDataFrame([("[[1,",)], "t string").select(R.read_beat_tuples(F.col("t"))).collect()


def test_match_keys(spark):
    df = spark.createDataFrame([("é <x>", " b&", "t ", "n.MP3", None), ("a", "b", "c", "", "/d.e/f"), ("a", "b", "c", " ", "/d/f.Wav"), ("", "b", "c", "x.mp3", "")], "a string, b string, c string, f string, p string")
    got = [r[0] for r in df.select(R.file_match_key(*[F.col(c) for c in "abcfp"])).collect()]
    assert got == ['[1,"é \\u003cx\\u003e","b\\u0026","t\\u2028","mp3"]', None, '[1,"a","b","c","wav"]', None]


def test_path_length_and_errors(spark):
    name = "/x.mp3".encode("utf-16-be")
    raw = b"PPTH" + struct.pack(">III", 16, 16 + len(name) + 4, len(name)) + name + "zz".encode("utf-16-be")
    assert spark.createDataFrame([(raw,)], "raw binary").select(codecs.audio_path(F.col("raw"))).first()[0] == "/x.mp3"
    rows = codecs.read_sections(spark.createDataFrame([("b", b"zz")], "path string, content binary"), errors=True).collect()
    assert [(r["path"], r["fourcc"], r["error"]) for r in rows] == [("b", None, "not a section file")]
    with pytest.raises(ValueError):
        codecs.canonical({"x": float("nan")})


def test_nearest_beats_with_equal_times(spark):
    beats = spark.createDataFrame([(1, 0, 100), (1, 1, 200), (1, 2, 200), (1, 3, 300)], "track long, i long, ms long")
    downs = spark.createDataFrame([(1, k, x) for k, x in enumerate([50, 150, 200, 249, 250, 251, 999])], "track long, d long, ms long")
    assert [r["i"] for r in cues.nearest_beat(downs, beats, "track").orderBy("d").collect()] == [0, 0, 1, 1, 1, 3, 3]
