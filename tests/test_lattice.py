"""Anchors against a plain version of the reference's rules."""

import numpy as np

from tactus.operators import lattice


def anchor(beats, low, high):
    beats = beats[np.isfinite(beats) & (beats >= 0)]
    n, best = len(beats), None
    for size in [] if n < 32 else [n] if n < 64 else [64] if n < 128 else [64, 128]:
        for start in range(0, n - size + 1, 8):
            t, x = beats[start : start + size], np.arange(size)
            period, origin = np.polyfit(x, t, 1)
            score = (t[-1] - t[0]) / (np.percentile(np.abs(t - origin - period * x), 95) + 0.005) ** 1.5
            if period > 0 and low <= 60 / period <= high and (best is None or score > best[0]):
                best = score, size, start, round(60 / period, 6)
    return best and best[1:]


def test_anchor_sizes(spark):
    rng, tracks = np.random.default_rng(1), {}
    for k, n in enumerate([7, 20, 31, 32, 40, 63, 64, 70, 127, 128, 131, 300]):
        t = np.arange(n) * 0.5 + rng.normal(0, 0.01, n).cumsum() * 0.3 + rng.normal(0, 0.004, n)
        tracks[k] = np.concatenate([[-1.0], t]) if k % 2 else t
    tracks[50] = np.concatenate([tracks[11], [np.nan, np.inf]])
    rows = [(k, i, float(x)) for k, t in tracks.items() for i, x in enumerate(t)]
    beats = spark.createDataFrame(rows, "track long, i long, t double")
    got = lattice.anchored(lattice.fitted(lattice.anchor_windows(beats, "track"), "track"), "track").collect()
    want = {k: a for k, t in tracks.items() if (a := anchor(t, lattice.MIN_BPM, lattice.MAX_BPM))}
    assert {r["track"]: (r["size"], r["start"], round(r["bpm"], 6)) for r in got} == want
    assert {size for size, *_ in want.values()} >= {40, 64, 128}
