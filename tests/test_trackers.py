"""Tempo operators against plain numpy versions of their rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.operators import trackers as T


@pytest.fixture(scope="module")
def tracks():
    rng, out = np.random.default_rng(7), {}
    for k, (n, p) in enumerate([(4, 0.5), (9, 0.48), (20, 0.61), (64, 0.5), (70, 0.4687), (150, 0.512), (300, 0.35)]):
        t = 0.3 + np.arange(n) * p + rng.normal(0, 0.006, n)
        out[k] = np.delete(t, [n // 3, n // 2]) if n > 60 else t  # missed beats
    return out


@pytest.fixture(scope="module")
def beats(spark, tracks):
    return spark.createDataFrame([(k, i, float(x)) for k, t in tracks.items() for i, x in enumerate(t)], "track long, i long, t double").cache()


def line(x, y):
    return np.polyfit(x, y, 1)


def off(t, origin, period):
    return t - (origin + np.rint((t - origin) / period) * period)


def consensus(t):
    if len(t) <= 8:
        return np.median(np.diff(t))
    s = (t[8:] - t[:-8]) / 8
    return np.median(s[(s > 0.2) & (s < 1.2)])


def lattice(t):
    c, fits = consensus(t), []
    w = min(64, len(t))
    for start in range(0, len(t) - w + 1, 32):
        own, period, origin = t[start : start + w], c, t[start]
        for _ in range(3):
            period, origin = line(np.rint((own - origin) / period), own)
        fits.append((abs(period - c) / c, off(own, origin, period).std(), start, period, origin))
    good = [f for f in fits if f[0] <= 0.02]
    return min(good, key=lambda f: f[1]) if good else min(fits)


def test_lattice(beats, tracks):
    got = {r["track"]: r for r in T.refit_origin(beats, T.fit_lattice(beats, "track"), "track").collect()}
    for k, t in tracks.items():
        _, spread, start, period, origin = lattice(t)
        assert (got[k]["start"], got[k]["period"], got[k]["origin"], got[k]["spread"]) == (start, *map(pytest.approx, (period, origin, spread)))
        d = off(t, origin, period)
        near = np.abs(d) < 0.05
        assert got[k]["refit"] == pytest.approx(origin + (d[near].mean() if near.sum() >= 16 else d.mean()))


def test_free_period_and_bpm(spark, beats, tracks):
    start = spark.createDataFrame([(k, float(consensus(t)) * 1.002) for k, t in tracks.items()], "track long, period double")
    rows = T.free_period(beats, start, "track").withColumn("duration", F.col("track") * 60.0 + 1)
    got = {r["track"]: r for r in rows.withColumn("c", T.choose_bpm(F.col("free"), F.col("duration"))).collect()}
    for k, t in tracks.items():
        p = consensus(t) * 1.002
        for _ in range(3):
            x = np.rint((t - t[0]) / p)
            keep = np.abs(t - (t[0] + x * p)) < p / 4
            if len(t) < 8 or keep.sum() < 8:
                break
            p = line(x[keep], t[keep])[0]
        assert got[k]["free"] == pytest.approx(p)
        want = next(((round(60 / p, d), d) for d in range(3) if abs(60 / round(60 / p, d) - p) * (k * 60 + 1) / p / 2 <= 0.005), (60 / p, None))
        assert (got[k]["c"]["bpm"], got[k]["c"]["digits"]) == (pytest.approx(want[0]), want[1])


def phases(t, p):
    out = []
    for phase in np.unique(np.round(np.mod(t, p), 4)):
        e = np.sort(np.abs(np.mod(t - phase + p / 2, p) - p / 2))
        out.append((e[: max(1, round(len(e) * 0.95))].mean(), np.percentile(e, 95), phase))
    return sorted(out)


def test_phases(beats, tracks):
    rows = beats.groupBy("track").agg(F.array_sort(F.collect_list("t")).alias("t")).withColumn("p", F.lit(0.47))
    got = {r["track"]: r for r in rows.withColumn("r", T.ranked_phases(F.col("t"), F.col("p"))).withColumn("s", T.apart(F.col("r"), F.col("p"), 4)).collect()}
    for k, t in tracks.items():
        want = phases(t, 0.47)
        assert [tuple(x) for x in got[k]["r"]] == [pytest.approx(w) for w in want]
        chosen = []
        for w in want:
            if len(chosen) < 4 and all(abs((w[2] - c[2] + 0.235) % 0.47 - 0.235) >= 0.05 for c in chosen):
                chosen.append(w)
        assert [x["phase"] for x in got[k]["s"]] == [pytest.approx(c[2]) for c in chosen]


def test_fallback(beats, tracks):
    got = {r["track"]: r for r in T.fallback_anchor(beats, "track", 70.0, 150.0).collect()}
    for k, t in tracks.items():
        d = np.diff(t)
        p = np.median(d[(d > 0.2) & (d < 2)])
        while 60 / p > 150:
            p *= 2
        score, p95, phase = phases(t, p)[0]
        assert (got[k]["period"], got[k]["phase"], got[k]["p95"]) == tuple(map(pytest.approx, (p, phase, p95)))


def test_local_fits(spark, beats, tracks):
    centres = spark.createDataFrame([(k, c) for k, t in tracks.items() for c in range(0, len(t), 5)], "track long, centre long")
    got = {(r["track"], r["centre"]): r for r in T.local_fits(beats, centres, "track", 70.0, 200.0).collect()}
    want = {}
    for k, t in tracks.items():
        size = min(64, len(t))
        for c in range(0, len(t), 5) if size >= 8 else []:
            start = max(0, min(c - size // 2, len(t) - size))
            own = t[start : start + size]
            period, phase = line(np.arange(size), own)
            if 70 <= 60 / period <= 200:
                want[k, c] = start, period, np.percentile(np.abs(own - phase - period * np.arange(size)), 95)
    assert {k: (r["start"], r["period"], r["p95"]) for k, r in got.items()} == {k: (v[0], pytest.approx(v[1]), pytest.approx(v[2], abs=1e-9)) for k, v in want.items()}


@pytest.mark.parametrize("anchor, period, duration", [(0.0, 0.5, 3.0), (1.37, 0.5, 2.0), (10.02, 0.48, 1.0), (-3.0, 0.5, 0.4), (0.4, 0.5, -1.0), (0.36, 0.48, 1.0)])
def test_grid(spark, anchor, period, duration):
    first = max(0.0, anchor)
    while first - period >= -0.25 * period:
        first -= period
    t, want = max(0.0, first), []
    while t <= duration:
        want.append(pytest.approx(t, abs=1e-9))
        t += period
    a, p, d = (F.lit(x) for x in (anchor, period, duration))
    assert spark.range(1).select(T.grid_beats(T.grid_origin(a, p), p, d).alias("g")).first()["g"] == want
    assert spark.range(1).select(T.grid_origin(F.lit(0.02), F.lit(0.5), 0.02).alias("g")).first()["g"] == 0.0


def test_strengths(spark):
    s = [0.1 * k for k in range(20)]
    df = spark.createDataFrame([(s, [])], "s array<double>, none array<double>")
    got = df.select(
        T.activation_strength(F.col("s"), F.lit(0.11)).alias("a"), T.activation_strength(F.col("s"), F.lit(9.0)).alias("b"), T.activation_strength(F.col("none"), F.lit(1.0)).alias("c"),
        T.audio_strength(F.col("s"), F.lit(1.0), F.lit(4.0), 10).alias("d"), T.audio_strength(F.col("s"), F.lit(9.0), F.lit(1.0), 10).alias("e"),
    ).first()
    part = np.array(s[10:13])  # rint(9.5) is 10
    assert tuple(got) == (pytest.approx(s[6]), pytest.approx(s[19]), 0.0, pytest.approx(np.sqrt((part**2).mean()) / 4), 0.0)


def test_posts(spark):
    rows = [(1, c, c * 0.5, 0.2 * (c % 3), 0.5, 100.0 + c % 2, 0.01 * c) for c in range(12)]
    df = spark.createDataFrame(rows, "track long, centre long, t double, activation double, energy double, fit_score double, p95 double")
    got = [r["centre"] for r in T.post_candidates(df, "track").orderBy("rank").collect()]
    assert got == [r[1] for r in sorted(rows, key=lambda r: (-(0.65 * r[3] + 0.35 * r[4]) * r[5], r[6], r[2]))[:4]]
