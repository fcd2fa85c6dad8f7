"""Published cases of grid arithmetic, scoring, arbitration and waves."""

import pytest
from pyspark.sql import functions as F

from tactus.functions import grid as g
from tactus.operators import catalog, consensus, score, waves


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "offset,beats,bars",
    [(0, 0, 0), (0.5, 1, 0), (-0.5, -1, 0), (1.0, 2, 0), (2.0, 0, 1), (-2.0, 0, -1), (2.5, 1, 1), (-2.5, -1, -1), (0.1, 0.2, 0)],
)
def test_phase(spark, offset, beats, bars):
    b, k = g.phase(F.lit(float(offset)), F.lit(0.5), F.lit(4.0))
    assert one(spark, b) == pytest.approx(beats) and one(spark, k) == bars


def test_phase_without_period(spark):
    b, k = g.phase(F.lit(1.0), F.lit(0.0), F.lit(4.0))
    assert (one(spark, b), one(spark, k)) == (0, 0)


SCORES = [
    ((120.2, 1050, 4), (120.0, 1000, 4), "pass"),
    ((121.0, 1000, 4), (120.0, 1000, 4), "tempo: near (within 2 BPM)"),
    ((120.0, 1500, 4), (120.0, 1000, 4), "phase: 1 beat(s)"),
    ((120.0, 3000, 4), (120.0, 1000, 4), "bars: whole bars off"),
    ((120.0, 1000, 3), (120.0, 1000, 4), "meter"),
    ((120.0, 1000, 4), (120.0, 1000, 0), "pass"),
    ((123.0, 980, 4), (123.0, -949, 4), "pass"),
    ((123.0, 2954, 4), (123.0, 1003, 4), "bars: whole bars off"),
    ((None, None, None), (120.0, 1000, 4), "error"),
    ((240.0, 1000, 4), (120.0, 1000, 4), "tempo: double"),
]


@pytest.mark.parametrize("got,ref,expected", SCORES)
def test_score(spark, got, ref, expected):
    row = spark.createDataFrame([(*got, *ref)], "got_bpm double, got_downbeat_ms long, got_bar long, ref_bpm double, ref_downbeat_ms long, ref_bar long")
    assert score.score(row).first()["class"] == expected


@pytest.mark.parametrize("beats,bpm,first", [([(2, 12400, 483), (3, 12400, 967), (4, 12400, 1451), (1, 12400, 1935)], 124.0, -1), ([(3, 12000, 200), (4, 12000, 700), (1, 12000, 1200)], 120.0, -800)])
def test_reduce(spark, beats, bpm, first):
    rows = spark.createDataFrame([("t", i, *b) for i, b in enumerate(beats)], "track string, ord long, n long, tempo long, ms long")
    out = score.reduce_grids(rows, ["track"]).first()
    assert out["bpm"] == bpm and abs(out["first_downbeat_ms"] - first) <= 1


def test_normal_name(spark):
    assert one(spark, g.normal_name(F.lit("/Volumes/X/Contents/9A - 125 - SAYLESS - BREAK (extended mix - v05).aiff"))) == "9a125saylessbreakextendedmixv05"


@pytest.mark.parametrize("key,code", [("D minor", "7A"), ("Bb major", "6B"), ("F# minor", "11A"), ("E major", "12B"), ("", ""), ("H major", "")])
def test_camelot(spark, key, code):
    assert one(spark, g.camelot(F.lit(key))) == code


@pytest.mark.parametrize("energy,byte", [(0.0, 0), (0.001, 0x81), (0.5, 0x90), (1.0, 0xDF)])
def test_energy(spark, energy, byte):
    assert one(spark, waves.packed_energy(F.lit(energy))) == byte


@pytest.mark.parametrize("n,rate,width", [(0, 44100, 1), (44100, 44100, 150), (44101, 44100, 151), (451, 22050, 4)])
def test_detail_width(spark, n, rate, width):
    assert one(spark, waves.detail_width(F.lit(n), F.lit(rate))) == width


def legs(spark, o, t, vote=0, agreement=0.0):
    return spark.createDataFrame([(o[0], 4, o[1], o[1], t[0], t[1], t[1], vote, agreement)], "o_bpm double, o_bar long, o_first_ms long, o_down_ms long, t_bpm double, t_first_ms long, t_down_ms long, vote long, agreement double")


def test_consensus(spark):
    same = consensus.arbitrated(legs(spark, (126.0, 0), (126.0, 0))).first()
    assert same["verdict"] == "agreed" and same["shift_ms"] is None
    moved = consensus.arbitrated(legs(spark, (120.0, 0), (120.0, 250))).first()
    assert moved["shift_ms"] == 250 and moved["verdict"] == "agreed"
    assert consensus.arbitrated(legs(spark, (126.0, 0), (126.0, 0), 2, 0.75)).first()["relabel_beats"] == 2
    told = consensus.arbitrated(legs(spark, (126.0, 0), (126.0, 0), 3, 0.65)).first()
    assert told["verdict"] == "disputed" and told["dispute"] == "downbeat vote -1"
    assert consensus.arbitrated(legs(spark, (120.0, 0), (120.0, 250)), arbitrate=False).first()["verdict"] == "disputed"


def test_merge_keeps_repeats_and_numbers_on(spark):
    have = spark.createDataFrame([(5, "p", None), (6, "q", "1")], "id long, provider string, version string")
    new = spark.createDataFrame([(1, "p", ""), (2, "r", "1"), (3, "r", "1")], "id long, provider string, version string")
    out = catalog.merge(have, new, ["provider", "version"], "id", ["id"]).orderBy("id").collect()
    assert [(r["id"], r["new_id"], r["selected"]) for r in out] == [(2, 7, 0), (3, 8, 0)]
