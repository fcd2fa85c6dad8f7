"""The seven waves against published values, plain versions of the rules, and any cut into chunks."""

import base64
import math

import numpy as np
import pytest

from tactus.operators import render as R
from tactus.streaming import frames

RATE = 44100


def sweep():
    t = np.arange(8 * RATE) / RATE
    return np.rint(0.7 * np.sin(2 * np.pi * (30 * t + 1300 * t * t)) * 32768).astype(np.int64)


#: Published values: the sweep's scales and the beginning of its first frame.
SWEEP_SCALES, SWEEP_FRAME = [143, 80, 138], "WQUAVwUAVwcAWAoAWBIAVxgAVhsAViMAVSoAVC4AUzUAUzoAUj8AUUQAUEcAT0oATkwATE4AS1AASVEA"


def drawn(x, step):
    own = R.Waves(RATE, len(x))
    for k in range(0, len(x), step):
        own.push(x[k : k + step])
    return own.waves()


def test_sweep_has_the_published_values():
    scales, rows = drawn(sweep(), 10007)
    assert scales == SWEEP_SCALES
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == [
        ("mono_preview", 1, 400, 0, "dat"), ("mono_detail", 1, 1200, 150, "ext"), ("color_preview", 6, 1200, 0, "ext"), ("color_detail", 2, 1200, 150, "ext"),
        ("three_band_preview", 3, 1200, 0, "twoex"), ("three_band_detail", 3, 1200, 150, "twoex"), ("three_band_scales", 2, 3, 0, "twoex"),
    ]
    assert rows[-1][-1] == bytes([0, 143, 0, 80, 0, 138])
    state = frames.Track(RATE)
    found = state.push(sweep()) + state.finish()
    want = np.frombuffer(base64.b64decode(SWEEP_FRAME), np.uint8).astype(int)
    assert np.abs(np.frombuffer(found[0][2], np.uint8)[: len(want)].astype(int) - want).max() <= 1
    assert [(f[0], f[1]) for f in found] == [(150 * k, 150) for k in range(8)]


def test_silence():
    scales, rows = drawn(np.zeros(RATE, int), 5000)
    assert scales == [0, 0, 500] and [len(r[-1]) for r in rows] == [400, 400, 7200, 300, 3600, 450, 6]


@pytest.mark.parametrize("seconds", [0.01, 0.4, 2.5])
def test_any_chunks_give_the_same(seconds):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=int(RATE * seconds)) * 6000).astype(np.int64)
    whole = drawn(x, len(x))
    for step in (1000, 441, 77777):
        assert drawn(x, step) == whole
    state, parts = frames.Track(RATE), frames.Track(RATE)
    once = state.push(x) + state.finish()
    cut = [f for k in range(0, len(x), 997) for f in parts.push(x[k : k + 997])] + parts.finish()
    assert once == cut and sum(f[1] for f in once) == R.detail_width(len(x), RATE)


def test_filter_is_its_recurrence():
    x, c = np.random.default_rng(1).normal(size=3000), frames.coefficients("high", 250.0, RATE)
    state, got = [0.0] * 4, []
    for part in np.split(x, [1, 2, 300, 556, 557, 2000]):
        got.append(frames.filtered(part, c, state))
    b0, b1, b2, a1, a2 = c
    x1 = x2 = y1 = y2 = 0.0
    want = []
    for v in x:
        y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
        x1, x2, y1, y2 = v, x1, y, y1
        want.append(y)
    assert np.concatenate(got) == pytest.approx(want, abs=1e-9) and state == pytest.approx([x1, x2, y1, y2], abs=1e-9)


def test_preview_averages_are_means_of_runs():
    for n in (1, 700, 1200, 1201, 5000, 30_000):
        source = np.random.default_rng(n).random((n, 3))
        want, at, remainder, column = np.zeros((1200, 3)), 0, 0, 0
        while column < 1200 and at < n:
            run = [at]
            while remainder + 1200 < n and at + 1 < n:
                remainder, at = remainder + 1200, at + 1
                run.append(at)
            remainder, at = remainder + 1200 - n, at + 1
            for lane, back in enumerate((n // 8000, n // 8000 * 2 // 3, n // 3000)):
                want[column, lane] = source[max(0, run[0] - back) : run[-1] + 1, lane].sum() / (len(run) + back)
            column += 1
        assert R.preview_averages(source) == pytest.approx(want)


def test_balance():
    for sums, want in (([1, 2, 4], [4, 2, 1]), ([1, 2, 0], [2, 1, 1]), ([3, 0, 6], [2, 1 / 16384, 1]), ([0, 5, 5], [1 / 16384, 1, 1]), ([7, 0, 0], [1 / 16384] * 3)):
        assert R.Norm(np.array([sums], float)).balance / 16384 == pytest.approx(want)


def test_colours():
    detail = np.array([[0, 0, 0], [20, 10, 5], [127, 127, 127]], np.uint8)
    got = R.colour_detail(detail, np.array([31, 4], np.uint8), [100, 100, 100])
    for (low, mid, high), pixel, height in zip(detail.astype(float), got, (31, 4, 0)):
        total = low + mid + high + 1
        rgb = [min(7, max(0, math.floor(sum(w * f for w, f in zip(row, (low, mid, high, 1, low / total, mid / total, high / total))) + 0.5))) for row in R.DETAIL_WEIGHTS]
        assert int(pixel) == rgb[0] << 13 | rgb[1] << 10 | rgb[2] << 7 | height << 2
    halved = R.colour_detail(np.array([[40, 20, 10]], np.uint8), np.zeros(0, np.uint8), [200, 200, 200])
    assert halved[0] == R.colour_detail(detail[1:2], np.zeros(0, np.uint8), [100, 100, 100])[0]


def test_rows_of_tracks(spark):
    rng = np.random.default_rng(9)
    tracks = {name: (rng.normal(size=n) * 5000).astype(int) for name, n in (("a", 30_000), ("b", 700), ("c", 44_100))}
    rows = [(name, k, x[k * 4000 : (k + 1) * 4000].tolist()) for name, x in tracks.items() for k in range(-(-len(x) // 4000))]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    chunks = spark.createDataFrame([*rows, ("d", 0, [])], "track string, seq long, samples array<int>")
    got = {(r["track"], r["kind"]): bytes(r["data"]) for r in R.rendered(chunks, RATE).collect()}
    assert len(got) == 28
    for name, x in tracks.items():
        assert all(got[name, w[0]] == w[-1] for w in drawn(x, len(x))[1])
    pieces = {}
    for r in frames.batch_frames(chunks, RATE).collect():
        pieces.setdefault(r["track"], []).append((r["offset"], r["columns"], bytes(r["data"])))
    for name, x in tracks.items():
        state = frames.Track(RATE)
        assert sorted(pieces[name]) == state.push(x) + state.finish()
